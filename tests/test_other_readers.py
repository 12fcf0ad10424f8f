"""What our encoders write, read by the image readers and archivers of the Java runtime."""

import numpy as np
import pytest

from siltstone.codecs import samples
from siltstone.codecs.registry import CODECS


def _read(spark, data: bytes) -> np.ndarray:
    """(height, width, 3) by Java. Gray samples are taken as they are, since Java's own conversion treats them as linear light."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    width, height, model = image.getWidth(), image.getHeight(), image.getColorModel()
    if image.getRaster().getNumBands() == 1 and "IndexColorModel" not in model.getClass().getName():
        gray = np.array(list(image.getRaster().getPixels(0, 0, width, height, spark.sparkContext._gateway.new_array(jvm.int, width * height))))
        return (gray * 255 // ((1 << model.getPixelSize()) - 1)).reshape(height, width, 1).repeat(3, axis=2)
    argb = np.array(list(image.getRGB(0, 0, width, height, None, 0, width)), np.int64)
    return (argb[:, None] >> np.array([16, 8, 0]) & 255).reshape(height, width, 3)


def _pictures():
    rng = np.random.default_rng(0)
    yield rng.integers(0, 9, (20, 30, 1)).astype(np.uint8).repeat(3, axis=2)
    yield (rng.integers(0, 2, (17, 9, 1)) * 255).astype(np.uint8).repeat(3, axis=2)
    yield rng.integers(0, 256, (21, 13, 3)).astype(np.uint8)


@pytest.mark.parametrize("kind", ["png", "zopflipng", "gif", "flexigif", "bmp", "tiff"])
def test_images(spark, kind):
    for pixels in _pictures():
        if "gif" in kind and (pixels[..., :1] != pixels).any():
            continue  # the samples of this kind are gray
        data = samples.image(kind, pixels)
        assert (_read(spark, data) == pixels).all() and (_read(spark, CODECS[kind].encode(data, True)) == pixels).all()


@pytest.mark.parametrize("shape", [(64, 48, 1, 0), (70, 33, 3, 0), (70, 33, 3, 2)])
def test_jpeg(spark, shape):
    width, height, components, interval = shape
    data = samples.jpeg_file(width, height, 0, components, interval)
    assert (_read(spark, data) == _read(spark, CODECS["jpeg"].encode(data, True))).all()
