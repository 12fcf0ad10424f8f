"""Operators on small literal tables, and sources and sinks."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalar
from siltstone.operators import expand, lookup, order, raster, report, select, series
from siltstone.sinks import csv_report, files
from siltstone.sources import scan


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_paths(spark):
    p = F.lit("/a/b.d/Name.Tar.GZ")
    assert one(spark, scalar.basename(p), scalar.extension(p), scalar.stem(p), scalar.parent(p), scalar.relative_to(p, "/a")) == ("Name.Tar.GZ", ".gz", "Name.Tar", "/a/b.d", "b.d/Name.Tar.GZ")
    assert one(spark, scalar.extension(F.lit("x/.hidden")), scalar.extension(F.lit("none"))) == ("", "")


def test_detection(spark):
    flac = b"fLaC" + bytes(22) + bytes(range(16))
    ogg = b"OggS" + bytes(22) + b"\x01" + b"\x1e" + b"\x01vorbis"
    assert one(spark, scalar.magic_mime(F.lit(b"\x89PNG\r\n\x1a\n")), scalar.magic_mime(F.lit(b"zz")), scalar.flac_md5(F.lit(flac)), scalar.is_vorbis(F.lit(ogg)), scalar.is_vorbis(F.lit(b"")), scalar.is_mp3_layer3(F.lit(b"\xff\xfb"))) == ("image/png", None, bytes(range(16)).hex(), True, False, True)
    assert one(spark, scalar.container_format(F.lit("application/java-archive"), F.lit("a.zip")), scalar.container_format(F.lit(""), F.lit("A.TZST")), scalar.container_format(F.lit(""), F.lit("a.none"))) == ("jar", "zst", "unknown")
    none = F.lit(None).cast("string")
    keys = F.array(F.lit("/FontFile3"))
    assert one(spark, scalar.pdf_stream_ext(F.lit("/Image"), F.lit("/DCTDecode"), F.array(), none, F.lit(b"")), scalar.pdf_stream_ext(none, none, keys, none, F.lit(b"")), scalar.pdf_stream_ext(none, none, F.array().cast("array<string>"), none, F.lit(b"%PDF-1"))) == (".jpg", ".cff", ".pdf")


def test_report_values(spark):
    lit = F.lit
    assert one(spark, scalar.kilobytes(lit(5000)), scalar.kilobytes(lit(-5000)), scalar.delta_percent(lit(200), lit(250), lit(True)), scalar.delta_percent(lit(0), lit(1), lit(True)), scalar.outcome(lit(True), lit(False))) == (4, -4, -25.0, 0.0, "OK (skipped)")
    assert one(spark, scalar.eta_text(lit(1), lit(4000), lit(1.0)), scalar.eta_text(lit(0), lit(9), lit(1.0)), scalar.progress_percent(lit(9999), lit(10000)), scalar.progress_percent(lit(0), lit(0))) == ("1h 06m 39s", "--:--", 99.9, 0.0)
    assert one(spark, scalar.csv_escape(lit('a"b,c')), scalar.csv_escape(lit("plain")), scalar.strip_ansi(lit("\x1b[1;31mred\x1b[0m")), scalar.truncated(lit("abcdefgh"), 6)) == ('"a""b,c"', "plain", "red", "abc...")


def test_safe_paths(spark):
    got = one(spark, *[scalar.safe_member_path(F.lit(p)) for p in ("", "../a", "/a", "a/./b", "a\\b", "a/../../b", "a/../b")])
    assert got == (None, None, "a", "a/b", "a/b", None, "b")


def test_natural_order(spark):
    names = ["p10", "p2", "p1b", "p1", "q", "p2a"]
    df = spark.createDataFrame([("g", n) for n in names], "g string, name string")
    assert [r.name for r in order.natural_rank(df, "g", "name").orderBy("rank").collect()] == ["p1", "p1b", "p2", "p2a", "p10", "q"]


def test_lookups(spark):
    df = spark.createDataFrame([("a.PNG", ""), ("b.x", "image/gif"), ("c.png", "application/pdf"), ("d.x", "none/none")], "path string, mime string")
    assert sorted((r.path, r.processor) for r in lookup.supported(df).collect()) == [("a.PNG", "png"), ("a.PNG", "zopflipng"), ("b.x", "flexigif"), ("b.x", "gif"), ("c.png", "pdf")]
    assert [r.path for r in lookup.unsupported(df).collect()] == ["d.x"]
    assert {r.path: r.processor for r in lookup.primary(df).collect()} == {"a.PNG": "png", "b.x": "gif", "c.png": "pdf"}
    assert lookup.by_extension(df).count() == 4 and lookup.by_mime(df).count() == 3
    links = spark.createDataFrame([(1, 5, 1, "x"), (1, 5, 2, "y"), (1, 6, 3, "z")], "dev int, ino int, seq int, rel string")
    assert {r.rel: r.target for r in lookup.link_targets(links, ["dev", "ino"], "seq", "rel").collect()} == {"x": "x", "y": "x", "z": "z"}
    old = spark.createDataFrame([("p", 0, b"a"), ("p", 1, b"b")], "parent_id string, seq int, content binary")
    assert [bytes(r.content) for r in lookup.reassociate(old, spark.createDataFrame([("p", 1, b"c")], "parent_id string, seq int, content binary")).orderBy("seq").collect()] == [b"a", b"c"]


def test_selection(spark):
    rows = [("a", 0, 5, True), ("a", 1, 5, True), ("a", 2, 4, False), ("b", 0, 9, False), ("b", 1, 7, False)]
    df = spark.createDataFrame(rows, "path string, idx int, size bigint, success boolean")
    assert {r.path: (r.idx, r.size, r.success) for r in select.best_candidate(df).collect()} == {"a": (0, 5, True), "b": (1, 7, False)}
    sizes = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, select.pipe_sizes(sizes(9, 12, 3)), select.pipe_sizes(sizes(9, 0, 3)), select.accepted(F.lit(3), F.lit(4)), select.accepted(F.lit(0), F.lit(4)), select.accepted(F.lit(4), F.lit(4))) == (3, None, True, False, False)
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("int")
    assert one(spark, select.gate_reason(f, F.lit(1), F.lit(2), t), select.gate_reason(t, n, F.lit(2), t), select.gate_reason(t, F.lit(2), F.lit(2), t), select.gate_reason(t, F.lit(1), F.lit(2), f), select.gate_reason(t, F.lit(1), F.lit(2), t)) == (select.UNSUPPORTED, select.FAILED, select.NO_GAIN, select.CORRUPT, None)
    assert one(spark, select.extraction_outcome(F.lit(2), f, t), select.extraction_outcome(F.lit(0), f, t), select.extraction_outcome(F.lit(0), f, f)) == ("Extracted", select.NO_ELEMENTS, select.EXTRACT_FAILED)


def test_descend_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "parent_id string, child_id string")
    assert expand.descend(edges, spark.createDataFrame([("a",)], "node string"), max_depth=4).count() == 5


def test_descend_reaches_every_depth(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(19)]
    roots = spark.createDataFrame([("n0",)], "node string")
    edges = spark.createDataFrame([*chain, ("n19", "n0"), ("n19", "n18")], "parent_id string, child_id string")
    got = expand.descend(edges, roots).collect()
    assert sorted((r.node, r.depth) for r in got) == sorted((f"n{i}", i) for i in range(20))
    twice = spark.createDataFrame([("n0", "a"), ("n0", "b"), ("a", "c"), ("b", "c")], "parent_id string, child_id string")
    assert sorted((r.node, r.depth) for r in expand.descend(twice, roots).collect()) == [("a", 1), ("b", 1), ("c", 2), ("c", 2), ("n0", 0)]


def test_series_and_rasters(spark):
    a = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 2.0), ("t", 0, 1.0), ("u", 0, 1.0)], "sid string, i int, v double")
    b = spark.createDataFrame([("s", 0, 1.0 + 1e-7), ("s", 1, 2.0), ("t", 0, 1.001)], "sid string, i int, v double")
    assert {r.sid: r.equal for r in series.equal_within(a, b, "sid", ["i"], "v", 1e-6).collect()} == {"s": True, "t": False, "u": False}
    px = spark.createDataFrame([("g", i, i, i, 255) for i in range(256)] + [("h", i % 256, i // 256, 0, 255) for i in range(257)], "image_id string, r int, g int, b int, a int")
    assert {r.image_id: (r.n_colours, r.all_gray, r.colour_type) for r in raster.colour_stats(px).collect()} == {"g": (256, True, "palette"), "h": (257, False, "rgb")}


def test_scan(spark, tmp_path):
    for name in ("a.png", "_b.png", ".c.png", "._d.png", ".DS_Store", "Desktop.INI", "sub/e.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    names = lambda df: sorted(os.path.relpath(r.path, tmp_path) for r in df.collect())
    assert names(scan.scan(spark, [str(tmp_path), str(tmp_path / "missing")])) == [".c.png", "_b.png", "a.png"]
    assert names(scan.scan(spark, [str(tmp_path)], recursive=True, exclude=["/sub/"], include=["(bad", "a.png", "e.png"])) == ["a.png"]
    assert names(scan.scan(spark, [str(tmp_path)], include=["(bad"])) == []
    got = scan.contents(scan.scan(spark, [str(tmp_path / "a.png")])).first()
    assert bytes(got.content) == b"xxxxx" and got.length == 5
    assert tuple(scan.stdin_files(spark, b"xy").first()) == ("stdin.bin", b"xy")
    with pytest.raises(ValueError):
        scan.scan(spark, ["-", "x"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("/in/a.png", b"new")], "path string, content binary")
    assert files.write_files(df, str(tmp_path / "out"), many=True).first().written == str(tmp_path / "out" / "a.png")
    assert (tmp_path / "out" / "a.png").read_bytes() == b"new" and os.listdir(tmp_path / "out") == ["a.png"]
    with pytest.raises(ValueError):
        files.replace(b"", str(tmp_path / "x"))
    assert files.target(None, "/a/b", False) == "/a/b" and files.target(str(tmp_path), "/a/b", False) == str(tmp_path / "b") and files.target(str(tmp_path / "n"), "/a/b", False) == str(tmp_path / "n")
    schema = "path string, container_origin string, mime string, size_before bigint, size_after bigint, success boolean, replaced boolean, seconds double, codecs_used array<struct<name:string,pct:double>>, error_msg string"
    rows = spark.createDataFrame([('b,"x', None, "m", 4096, 2048, True, True, 0.5, [("png", 50.0), ("zopflipng", 1.5)], None), ("a", None, "m", 10, 10, False, False, 0.0, [], "bad")], schema)
    none = spark.createDataFrame([], "filename string, format string, size_before bigint, size_after bigint, success boolean, error_msg string")
    csv_report.write_report(rows, none, str(tmp_path / "r.csv"), 1.0, "pipe")
    text = (tmp_path / "r.csv").read_text().splitlines()
    assert text[0] == ",".join(csv_report.FILES) and '"b,""x",,m,4,2,50.00,0.50,OK (replaced),png:50.00% -> zopflipng:1.50%,' in text and text[-1] == "1.00,pipe"
    assert csv_report.console_table(rows).splitlines()[1].startswith("a ")
    assert report.totals(rows).first()[:3] == (2, 4106, 2048)


def brute_sessions(rows, gap):
    """Sessions of each user by a plain loop: an event at most ``gap`` after the last one continues the session, as session_window has it."""
    out, last = [], {}
    for user, ts in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        s = last.get(user)
        if s and ts - s[1] <= gap:
            s[1], s[2] = ts, s[2] + 1
        else:
            last[user] = s = [ts, ts, 1]
            out.append((user, s))
    return sorted(((u, a, b + gap, n) for u, (a, b, n) in out), key=str)


@pytest.mark.parametrize("parts", [1, 3])
def test_sessions_of_a_bounded_table(spark, tmp_path, parts):
    from siltstone.streaming.sessions import finished_sessions

    rng, start = random.Random(9), dt.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 2, 3, None]), start + dt.timedelta(minutes=rng.randrange(3000))) for _ in range(300)] + [(5, start), (5, start + dt.timedelta(minutes=30)), (6, None)]
    df = spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz")
    df.repartition(parts).write.parquet(str(tmp_path / ("events.parquet" if parts > 1 else "out")))
    if parts == 1:
        next((tmp_path / "out").glob("*.parquet")).rename(tmp_path / "events.parquet")
    got = finished_sessions(spark, str(tmp_path), "events.parquet").select("user_id", F.col("starttime").cast("timestamp_ntz"), F.col("endtime").cast("timestamp_ntz"), "n")
    assert sorted(map(tuple, got.collect()), key=str) == brute_sessions(rows, dt.timedelta(minutes=30))
