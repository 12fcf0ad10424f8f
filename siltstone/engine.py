"""The engine: scan, detect, look up, expand, encode, gate, reassemble, write, report.

Files and container members are rows of one table of nodes. Containers are expanded level by level; leaves are encoded by the codecs
of their processors, chained or side by side, and a result counts only if it is smaller and decodes to the same content; then archives, and
sound files with a better cover, are rebuilt from the deepest level up, under the same gate. Lookups and orderings move no bytes; each phase ends
in a written table, so encoders run once and lineage is short. Of a container only its members' bytes meet its row, once, and for sound files the
bytes around the covers.
"""

from __future__ import annotations

import dataclasses
import os
import time
import uuid
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codecs import audio
from .codecs.containers import AUDIO, Unreadable, read_members, write_members
from .codecs.registry import BUILT_IN, CODECS, Codec, added, raw_equal
from .events import EventBus, FileError, FileFinish, FileSkipped, FileStart, Log
from .functions import scalar
from .operators import lookup, select
from .plans import dims
from .session import removed, setting, shared_folder, written
from .settings import Settings
from .sinks import csv_report, files as file_sink
from .sources import scan

NODES = "id string, parent_id string, path string, depth int, seq int, rel_path string, kind string, link string, content binary"
CODEC_LIST = "array<struct<name: string, pct: double>>"
OUTCOMES = f"id string, size_before bigint, size_after bigint, replaced boolean, reason string, seconds double, codecs_used {CODEC_LIST}, new_content binary"
ARCHIVES = ("archive", "ooxml", "odf")
CONTAINER_PROCESSORS = (*ARCHIVES, *(p[0] for p in dims.PROCESSORS if p[2] and any(m.startswith("audio/") for m in p[3])))


class Observer(Protocol):
    def on_file_start(self, path: str) -> None: ...
    def on_file_finish(self, path: str, before: int, after: int, replaced: bool) -> None: ...
    def on_file_error(self, path: str, message: str) -> None: ...
    def on_log(self, level: str, message: str) -> None: ...


@dataclasses.dataclass
class Run:
    """What a run gives: results per file (roots and members), containers, events, and its time."""

    results: DataFrame
    containers: DataFrame
    events: DataFrame
    seconds: float
    folder: str


def encode_all(data: bytes, processors: list[str], mode: str, keep_metadata: bool, verify: bool, codecs: dict[str, Codec] = CODECS) -> dict:
    """Runs the codecs of the processors on one file's bytes and gates the result. Processors without a codec are left out."""
    began, before = time.perf_counter(), len(data)
    steps = [p for p in processors if p in codecs]
    used, best, reason, chosen = [], None, None, None
    if not steps:
        reason = "unavailable"
    elif mode == "pipe":
        current = data
        for p in steps:
            try:
                current = codecs[p].encode(current, keep_metadata)
            except Exception as e:
                current, reason = b"", f"{select.FAILED}: {e}"
            if not current:
                reason = reason or select.FAILED
                break
            used.append({"name": p, "pct": 100.0 * (1 - len(current) / before) if before else 0.0})
        best, chosen = current or None, steps[0]
    else:
        sizes = []
        for i, p in enumerate(steps):
            try:
                out = codecs[p].encode(data, keep_metadata)
            except Exception as e:
                reason = f"{select.FAILED}: {e}"
                continue
            if out:
                sizes.append((len(out), i, p, out))
                used.append({"name": p, "pct": 100.0 * (1 - len(out) / before) if before else 0.0})
        if sizes:
            _, _, chosen, best = min(sizes, key=lambda s: s[:2])
            reason = None
    if best is not None and len(best) >= before:
        best, reason = None, select.NO_GAIN
    if best is not None and verify and not raw_equal(chosen, data, best, codecs):
        best, reason = None, select.CORRUPT
    return {"size_before": before, "size_after": before if best is None else len(best), "replaced": best is not None, "reason": None if best is not None else reason, "seconds": time.perf_counter() - began, "codecs_used": used, "new_content": best}


class Engine:
    """Builder of runs: ``Engine(spark).mode("parallel").output_directory(d).recompress(paths)``."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark, self.settings, self.events = spark, settings or Settings(), EventBus()
        self._tag = f"siltstone-{uuid.uuid4().hex}"

    def _with(self, **changes) -> Engine:
        self.settings = dataclasses.replace(self.settings, **changes)
        return self

    def preserve_metadata(self, on: bool = True) -> Engine:
        return self._with(preserve_metadata=on)

    def verify_checksums(self, on: bool = True) -> Engine:
        return self._with(verify_checksums=on)

    def dry_run(self, on: bool = True) -> Engine:
        return self._with(dry_run=on)

    def partitions(self, n: int) -> Engine:
        return self._with(partitions=n)

    def mode(self, mode: str) -> Engine:
        return self._with(mode=mode)

    def output_directory(self, path: str) -> Engine:
        return self._with(output=path)

    def set_observer(self, observer: Observer) -> Engine:
        """Subscribes an observer. Starts are published before files are encoded, finishes and errors after, log messages in between; a
        skipped file finishes with sizes 0. Without subscribers no event comes to the driver."""
        self.events.subscribe(FileStart, lambda e: observer.on_file_start(e.path))
        self.events.subscribe(FileFinish, lambda e: observer.on_file_finish(e.path, e.before, e.after, e.replaced))
        self.events.subscribe(FileSkipped, lambda e: observer.on_file_finish(e.path, 0, 0, False))
        self.events.subscribe(FileError, lambda e: observer.on_file_error(e.path, e.message))
        self.events.subscribe(Log, lambda e: observer.on_log(e.level, e.message))
        return self

    def stop(self) -> None:
        """Cancels the jobs of running calls."""
        self.spark.interruptTag(self._tag)

    def _written(self, df: DataFrame) -> DataFrame:
        return written(df, f"{self._folder}/{uuid.uuid4().hex}")

    def _log(self, message: str, level: str = "info") -> None:
        self.events.publish(Log(level, message))

    def recompress(self, inputs: list[str] | str) -> Run:
        """Runs on paths. Folders are listed (all levels if recursive), filters apply, and results are written unless it is a dry run. The report is one
        CSV file, or a folder of parts if the path is one."""
        inputs = [inputs] if isinstance(inputs, str) else list(inputs)
        s = self.settings
        s.check_stdin(inputs)
        files = scan.scan(self.spark, inputs, s.recursive, list(s.include), list(s.exclude)).cache()
        known = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()
        self._log(f"{known.n} files, {known.size} bytes")
        # so many tasks that long files spread, with a bound on what each reads
        n = s.partitions or max(self.spark.sparkContext.defaultParallelism, -(-known.size // s.task_bytes))
        run = self.run_files(scan.contents(files.repartition(int(n))).select("path", "content"))
        files.unpersist()
        if not s.dry_run:
            roots = run.results.where("container_origin is null and replaced").select("path", F.col("new_content").alias("content"))
            done = file_sink.write_files(roots, s.output, len(inputs) > 1 or known.n > 1).count()
            self._log(f"{done} files written")
        if s.report and (s.report.endswith("/") or os.path.isdir(s.report)):
            csv_report.write_parts(run.results, run.containers, s.report, s.mode)
        elif s.report:
            csv_report.write_report(run.results, run.containers, s.report, run.seconds, s.mode)
        return run

    def run_files(self, files: DataFrame) -> Run:
        """From path and content to results, without writing files: everything from detection to reassembly."""
        began, self._folder = time.perf_counter(), shared_folder(self.spark)
        self.spark.addTag(self._tag)
        try:
            with setting(self.spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(self.settings.batch_files)):
                levels = self._expand(files)
                self._log(f"{len(levels) - 1} levels of containers")
                self._notify_starts(levels)
                leaves = self._encode(levels)
                outcomes = self._finalize(levels, leaves)
            run = self._report(levels, outcomes, time.perf_counter() - began)
        finally:
            self.spark.removeTag(self._tag)
        self._notify_ends(run)
        return run

    def clean(self, run: Run) -> None:
        """Deletes the tables of a run, its results among them."""
        removed(self.spark, run.folder)

    def _detected(self, nodes: DataFrame) -> DataFrame:
        name = F.coalesce("rel_path", "path")
        typed = nodes.withColumn("mime", F.coalesce(scalar.magic_mime(F.col("content")), F.lit(""))).withColumn("_name", name)
        # a zip or an unknown type may be told better by its name
        ext = scalar.mime_by_extension(F.col("_name"))
        named = F.when((F.col("mime").isin("", "application/zip", "application/gzip")) & (ext != dims.DEFAULT_MIME), ext).otherwise(F.col("mime"))
        found = lookup.with_fallback(typed.withColumn("mime", named), "_name").withColumn("processors", F.transform("processors", lambda p: p["processor"]))
        sound = F.arrays_overlap("processors", F.lit([p for p in CONTAINER_PROCESSORS if p not in ARCHIVES]))
        return found.withColumn("format", F.when(sound, AUDIO).otherwise(scalar.container_format(F.col("mime"), F.col("_name")))).drop("_name")

    def _expand(self, files: DataFrame) -> list[DataFrame]:
        none = F.lit(None)
        roots = files.select(F.col("path").alias("id"), none.cast("string").alias("parent_id"), "path", F.lit(0).alias("depth"), F.lit(0).alias("seq"), none.cast("string").alias("rel_path"), F.lit("file").alias("kind"), none.cast("string").alias("link"), "content")
        levels = [self._written(self._detected(roots))]
        most, top = self.settings.max_bytes, self.settings.max_depth

        def open_all(batches):
            for frame in batches:
                for r in frame.to_dict("records"):
                    try:
                        rows = [(f"{r['id']}!{i}", r["id"], r["path"], int(r["depth"]) + 1, i, m[0], m[1], m[3], m[2]) for i, m in enumerate(read_members(bytes(r["content"]), r["format"], most))]
                    except Unreadable as e:
                        rows = [(f"{r['id']}!", r["id"], r["path"], int(r["depth"]) + 1, -1, None, "error", str(e), None)]
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])

        while len(levels) <= top:
            packed = levels[-1].where(F.arrays_overlap("processors", F.lit(list(CONTAINER_PROCESSORS))) & (F.col("kind") == "file") & F.col("content").isNotNull())
            below = packed.select("id", "path", "depth", "format", "content").mapInPandas(open_all, NODES)
            level = self._written(self._detected(below))
            if level.isEmpty():
                break
            levels.append(level)
        return levels

    def _encode(self, levels: list[DataFrame]) -> DataFrame:
        s = self.settings
        keep, verify, mode = s.preserve_metadata, s.verify_checksums, s.mode
        nodes = levels[0]
        for level in levels[1:]:
            nodes = nodes.unionByName(level)
        able = [p[0] for p in dims.PROCESSORS if p[1] or p[0] in CODECS]

        extra = added()

        def run(batches):
            codecs = BUILT_IN | extra
            for frame in batches:
                rows = [{"id": i, **encode_all(bytes(b), [p for p in ps if p in able], mode, keep, verify, codecs)} for i, b, ps in zip(frame["id"], frame["content"], frame["processors"], strict=True)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("id", "size_before", "size_after", "replaced", "reason", "seconds", "codecs_used", "new_content")])

        todo = nodes.where(F.col("content").isNotNull() & (F.col("kind") == "file") & F.arrays_overlap("processors", F.lit(able)))
        return self._written(todo.select("id", "content", "processors").mapInPandas(run, OUTCOMES))

    def _finalize(self, levels: list[DataFrame], outcomes: DataFrame) -> DataFrame:
        """Children before parents: an archive is built anew from its members, a sound file if a cover of it got better, and kept if that is smaller."""
        done = outcomes

        def rebuilt(r: dict) -> dict:
            began, before = time.perf_counter(), int(r["size_before"])
            rows = [(m["rel_path"], m["kind"], bytes(m["data"]) if m["data"] is not None else None, m["link"]) for m in sorted(r["members"], key=lambda m: m["seq"])]
            try:
                if r["format"] == AUDIO:
                    base = bytes(r["base"])
                    new = audio.with_pictures(base, [c for _, _, c, _ in rows])
                    same = audio.without_pictures(new) == audio.without_pictures(base)
                else:
                    new = write_members(rows, r["format"])
                    same = {m[:3] for m in read_members(new, r["format"])} == {(p, k, c) for p, k, c, _ in rows}
                new, reason = (new, select.NO_GAIN) if same else (b"", select.CORRUPT)
            except (Unreadable, ValueError) as e:
                new, reason = b"", f"{select.FAILED}: {e}"
            good = 0 < len(new) < before
            used = [*(r["used"] if r["used"] is not None else []), *([{"name": "covers" if r["format"] == AUDIO else "archive", "pct": 100.0 * (1 - len(new) / before)}] if good else [])]
            return {"id": r["id"], "size_before": before, "size_after": len(new) if good else before, "replaced": good, "reason": None if good else reason, "seconds": time.perf_counter() - began, "codecs_used": used, "new_content": new if good else None}

        def run(batches):
            for frame in batches:
                yield pd.DataFrame([rebuilt(r) for r in frame.to_dict("records")], columns=[c.split()[0] for c in ("id", "size_before", "size_after", "replaced", "reason", "seconds", "codecs_used", "new_content")])

        for depth in range(len(levels) - 1, 0, -1):
            better = F.col("new_content").isNotNull()
            members = levels[depth].join(done.select("id", "new_content"), "id", "left")
            member = F.struct("seq", "rel_path", "kind", "link", F.coalesce("new_content", "content").alias("data"))
            members = members.groupBy(F.col("parent_id").alias("id")).agg(F.collect_list(member).alias("members"), F.max(better).alias("better"), F.max(F.col("kind") == "error").alias("closed"))
            members = members.where((F.size("members") > 0) & ~F.col("closed"))
            parents = levels[depth - 1].select("id", "format", F.octet_length("content").cast("bigint").alias("size_before"), F.when(F.col("format") == AUDIO, F.col("content")).alias("content"))
            # what a sound file's own codec has made is the base of its covers
            own = done.select("id", F.col("codecs_used").alias("used"), F.col("new_content").alias("mine"))
            parents = parents.join(own, "id", "left").select("id", "format", "size_before", "used", F.when(F.col("format") == AUDIO, F.coalesce("mine", "content")).alias("base"))
            built = members.join(parents, "id").where(F.col("better") | (F.col("format") != AUDIO)).select("id", "format", "size_before", "used", "base", "members").mapInPandas(run, OUTCOMES)
            built = self._written(built)
            # a sound file keeps what its codec has made if its covers bring nothing
            done = self._written(done.join(built.where("replaced").select("id"), "id", "left_anti").unionByName(built.where("replaced")).unionByName(built.where("not replaced").join(done.select("id"), "id", "left_anti")))
        return done

    def _report(self, levels: list[DataFrame], outcomes: DataFrame, seconds: float) -> Run:
        nodes = None
        for level in levels:
            part = level.select("id", "parent_id", "path", "depth", "rel_path", "kind", "mime", "format", "processors", F.octet_length("content").cast("bigint").alias("size"))
            nodes = part if nodes is None else nodes.unionByName(part)
        # the members of each container, and whether it could be read
        inside = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count_if(F.col("kind") != "error").alias("children"), F.max(F.col("kind") == "error").alias("closed"))
        nodes = nodes.where("kind = 'file'")
        all_rows = nodes.join(outcomes, "id", "left").join(inside, "id", "left").fillna(0, ["children"]).fillna(False, ["closed"])
        opened = F.arrays_overlap("processors", F.lit(list(CONTAINER_PROCESSORS)))
        able = F.arrays_overlap("processors", F.lit([p[0] for p in dims.PROCESSORS if p[1]]))
        outcome = select.extraction_outcome(F.col("children"), F.col("closed"), able)
        deep = opened & (F.col("depth") == self.settings.max_depth) & (F.col("format") != AUDIO)
        reason = (
            F.when(F.size("processors") == 0, select.UNSUPPORTED)
            .when(deep, select.TOO_DEEP)
            .when(opened & outcome.isin(select.EXTRACT_FAILED), outcome)
            .when(opened & ~F.coalesce("replaced", F.lit(False)) & outcome.isin(select.NO_ELEMENTS), F.coalesce("reason", outcome))
            .otherwise(F.col("reason"))
        )
        failed = F.coalesce(reason.startswith(select.FAILED) | (reason == select.CORRUPT) | (reason == select.EXTRACT_FAILED) | (reason == select.TOO_DEEP), F.lit(False))
        label = F.when(F.col("parent_id").isNull(), F.col("path")).otherwise(F.concat_ws("!", "path", "rel_path"))
        results = self._written(all_rows.select(
            label.alias("path"), F.when(F.col("parent_id").isNotNull(), F.col("path")).alias("container_origin"), "mime", "format", opened.alias("is_container"),
            F.coalesce("size_before", "size").alias("size_before"), F.coalesce("size_after", "size").alias("size_after"), (~failed).alias("success"), F.coalesce("replaced", F.lit(False)).alias("replaced"),
            F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("codecs_used", F.array().cast(CODEC_LIST)).alias("codecs_used"), reason.alias("error_msg"), "new_content",
        ))
        containers = results.where("is_container").select(F.col("path").alias("filename"), "format", "size_before", "size_after", "success", "error_msg")
        kind = F.when(~F.col("success"), "error").when(F.col("error_msg") == select.UNSUPPORTED, "skipped").otherwise("complete")
        events = results.select(F.when(F.col("is_container"), "finalize").otherwise("process").alias("phase"), kind.alias("kind"), "path", F.col("error_msg").alias("reason"), F.col("size_before").alias("original_size"), F.col("size_after").alias("new_size"), "replaced", (F.col("seconds") * 1000).cast("bigint").alias("duration_ms"))
        return Run(results, containers, events, seconds, self._folder)

    def _notify_starts(self, levels: list[DataFrame]) -> None:
        if self.events.wants(FileStart):
            for level in levels:
                for r in level.where("kind = 'file'").select("path", "rel_path", "parent_id").toLocalIterator():
                    self.events.publish(FileStart(r.path if r.parent_id is None else f"{r.path}!{r.rel_path}"))

    def _notify_ends(self, run: Run) -> None:
        if self.events.wants(FileFinish, FileSkipped, FileError):
            for e in run.events.toLocalIterator():
                if e.kind == "error":
                    self.events.publish(FileError(e.path, e.reason or ""))
                elif e.kind == "skipped":
                    self.events.publish(FileSkipped(e.path, e.reason))
                else:
                    self.events.publish(FileFinish(e.path, e.original_size, e.new_size, bool(e.replaced)))
