import io
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest

from siltstone.codecs import images
from siltstone.engine import Engine
from siltstone.settings import Settings


def png(pixels, level=1):
    height, width, n = pixels.shape
    rows = pixels.reshape(height, -1)
    body = zlib.compress(images._filtered(rows, n, 0), level)
    return images.SIGNATURE + images._chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[n], 0, 0, 0)) + images._chunk(b"IDAT", body) + images._chunk(b"IEND", b"")


@pytest.fixture()
def folder(tmp_path):
    art = png(np.repeat(np.arange(64, dtype=np.uint8)[:, None, None], 64, axis=1).repeat(3, axis=2))
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_STORED) as z:
        z.writestr("deep.png", art)
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("x.png", art)
        z.writestr("note.txt", "hello " * 100)
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("../evil", "no")
    (tmp_path / "b.png").write_bytes(art)
    (tmp_path / "_c.png").write_bytes(art[:40])
    (tmp_path / "._d.png").write_bytes(art)
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "z.unknown").write_bytes(b"????")
    (tmp_path / "empty.png").write_bytes(b"")
    return tmp_path


@pytest.mark.parametrize("mode", ["pipe", "parallel"])
def test_round_trip(spark, folder, tmp_path, mode):
    out = tmp_path / "out"
    run = Engine(spark).mode(mode).output_directory(str(out)).recompress([str(folder)])
    rows = {os.path.relpath(r.path, folder): r for r in run.results.collect()}
    assert "._d.png" not in rows
    assert rows["b.png"].replaced and rows["b.png"].size_after < rows["b.png"].size_before
    assert not rows["_c.png"].success and not rows["_c.png"].replaced
    assert rows["z.unknown"].error_msg == "Unsupported format"
    assert not rows["bad.zip"].success
    assert rows["a.zip"].replaced and rows["a.zip!inner.zip!deep.png" if "a.zip!inner.zip!deep.png" in rows else "a.zip!deep.png"].replaced
    with zipfile.ZipFile(out / "a.zip") as z:
        assert z.namelist() == ["x.png", "note.txt", "inner.zip"]
        assert images.decode_png(z.read("x.png"))[2].tobytes() == images.decode_png((folder / "b.png").read_bytes())[2].tobytes()
        assert z.read("note.txt") == b"hello " * 100
        with zipfile.ZipFile(io.BytesIO(z.read("inner.zip"))) as y:
            assert len(y.read("deep.png")) < (folder / "b.png").stat().st_size
    assert (out / "b.png").stat().st_size == rows["b.png"].size_after


def test_dry_run_and_report(spark, folder, tmp_path):
    before = {p.name: p.read_bytes() for p in folder.iterdir() if p.is_file()}
    report = tmp_path / "report.csv"
    seen = []

    class Watch:
        def on_file_start(self, path):
            seen.append(("start", path))

        def on_file_finish(self, path, before, after, replaced):
            seen.append(("finish", path))

        def on_file_error(self, path, message):
            seen.append(("error", path))

        def on_log(self, level, message):
            pass

    Engine(spark, Settings(report=str(report), dry_run=True)).set_observer(Watch()).recompress(str(folder))
    assert before == {p.name: p.read_bytes() for p in folder.iterdir() if p.is_file() and p != report}
    text = report.read_text().splitlines()
    assert text[0].startswith("File,Container,MIME,Before(KB)") and "Total amount of time,Encoding mode used" in text
    assert {k for k, _ in seen} == {"start", "finish", "error"}


def test_settings_are_checked():
    for bad in ({"mode": "both"}, {"log_level": "loud"}, {"partitions": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)
    with pytest.raises(ValueError):
        Settings().check_stdin(["-"])
    with pytest.raises(ValueError):
        Settings(output="x").check_stdin(["-", "y"])
