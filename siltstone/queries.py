"""The catalogue of queries, each with its SQL where SQL can express it.

The tables stand in for files: pages and documents are files (url or source/doc_id.lang is the path), conversations are ordered
container members, region, nation and customer are nested containers, events are an event log and a time series, embeddings are
sample arrays, orders and lineitem are container totals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import expand, lookup, order, raster, report, select, series
from .plans import dims

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_path() -> Column:
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")


_DOC_PATH = "source || '/' || doc_id || '.' || lang"
_PAGE_EXT = r"lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.].*?(\.[^.]*)$', 1))"


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the path is the url without query and fragment, the type is told from html's first bytes."""
    p = _t(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "[?#].*$", "")
    # stand-in types: a third each of images, archives and untold ones, by page
    kind = F.pmod("page_id", F.lit(6))
    mime = F.when(kind == 0, "image/png").when(kind == 1, "application/zip").when(kind == 2, "image/gif").when(kind == 3, "text/html").otherwise("")
    ext = F.when(kind == 4, ".PNG").when(kind == 5, ".tar").otherwise("")
    return p.select("page_id", F.concat(path, ext).alias("path"), mime.alias("mime"))


_PAGE_FILES = """files as (select page_id, regexp_replace(url, '[?#].*$', '') || case page_id % 6 when 4 then '.PNG' when 5 then '.tar' else '' end as path,
    case page_id % 6 when 0 then 'image/png' when 1 then 'application/zip' when 2 then 'image/gif' when 3 then 'text/html' else '' end as mime from pages)"""
_PROC_MIMES = dims.values_sql([(p[0], i, m) for i, p in enumerate(dims.PROCESSORS) for m in p[3]], "pm(processor, priority, pmime)")
_PROC_EXTS = dims.values_sql([(p[0], i, e) for i, p in enumerate(dims.PROCESSORS) for e in p[4]], "pe(processor, priority, pext)")


@query("select doc_id, strlen(text) as length from documents")
def q01_scan_lengths(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("length"))


_NAMES = "case doc_id % 5 when 0 then '._' || doc_id when 1 then '.DS_Store' when 2 then 'Desktop.ini' when 3 then '_keep' || doc_id || '.png' else 'doc' || doc_id || '.txt' end"


@query(f"select doc_id, name from (select doc_id, {_NAMES} as name from documents) where not (starts_with(name, '._') or lower(name) in ('.ds_store', 'desktop.ini'))")
def q02_junk_filter(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    kind = F.pmod("doc_id", F.lit(5))
    name = F.when(kind == 0, F.concat(F.lit("._"), d)).when(kind == 1, ".DS_Store").when(kind == 2, "Desktop.ini").when(kind == 3, F.concat(F.lit("_keep"), d, F.lit(".png"))).otherwise(F.concat(F.lit("doc"), d, F.lit(".txt")))
    return _t(spark, sf_dir, "documents").select("doc_id", name.alias("name")).where(~scalar.is_junk(F.col("name")))


@query("select page_id, url from pages where not regexp_matches(url, '/de/') and (regexp_matches(url, 'example[.](com|org)') or regexp_matches(url, '[.]html$'))")
def q03_include_exclude(spark, sf_dir):
    from .sources.scan import path_filter

    return _t(spark, sf_dir, "pages").select("page_id", "url").where(path_filter(F.col("url"), include=["example[.](com|org)", "[.]html$", "(broken"], exclude=["/de/"]))


def _magic_sql(content: str) -> str:
    digits = lambda o, m: f" and regexp_matches(substr({content}, 1, {2 * o}), '^(3[0-9]|20|00){{{o}}}$')" if (o, m) in dims.MAGIC_DIGITS else ""
    return "case " + " ".join(f"when substr({content}, {2 * o + 1}, {len(d)}) = '{d}'{digits(o, m)} then '{m}'" for o, d, m in dims.MAGIC) + " end"


_CONTENT = "case id % 7 when 0 then chr(37) || 'PDF-1.7' || body when 1 then 'GIF89a' || body when 2 then 'fLaC' || body when 3 then 'OggS' || body when 4 then 'BZh9' || body when 5 then 'BM' || body else body end"


@query(f"""select id, coalesce({_magic_sql('h')}, '') as mime from (select id, hex(encode({_CONTENT})) as h from
    (select doc_id as id, text as body from documents union all select -1 - page_id, html from pages))""")
def q04_detect_magic(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")).unionAll(_t(spark, sf_dir, "pages").select(-1 - F.col("page_id"), "html"))
    kind = F.col("id") % 7
    heads = ("%PDF-1.7", "GIF89a", "fLaC", "OggS", "BZh9", "BM")
    content = F.col("body")
    for i, head in reversed(list(enumerate(heads))):
        content = F.when(kind == i, F.concat(F.lit(head), "body")).otherwise(content)
    return rows.select("id", F.coalesce(scalar.magic_mime(content.cast("binary")), F.lit("")).alias("mime"))


@query(f"""with {_PAGE_FILES} select page_id, coalesce(mime2, '{dims.DEFAULT_MIME}') as mime from (select page_id, {_PAGE_EXT} as ext from files)
    left join {dims.values_sql(dims.EXT_MIMES.items(), 'm(ext2, mime2)')} on ext = ext2""")
def q05_mime_by_ext(spark, sf_dir):
    return _page_files(spark, sf_dir).select("page_id", scalar.mime_by_extension(F.col("path")).alias("mime"))


_ALIASES = ("ZIP", "gzip", "Lib", "war", "aab", "nupkg", "tzst", "none")


@query(f"""select doc_id, coalesce(format, 'unknown') as format, coalesce(format, 'unknown') not in ('7z', 'rar', 'wim', 'unknown') as writable from
    (select doc_id, [{', '.join(f"'{a}'" for a in _ALIASES)}][doc_id % {len(_ALIASES)} + 1] as a from documents) left join {dims.values_sql(dims.FORMAT_ALIASES.items(), 'm(alias, format)')} on lower(a) = alias""")
def q06_format_alias(spark, sf_dir):
    alias = F.get(F.array(*map(F.lit, _ALIASES)), F.pmod("doc_id", F.lit(len(_ALIASES))).cast("int"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce(scalar.format_name(alias), F.lit("unknown")).alias("format"))
    return rows.withColumn("writable", scalar.can_write(F.col("format")))


_SUFFIXES = (".tar.gz", ".TAR.BZ2", ".tar.xz", ".tar.zst", ".tgz.bin", "")


@query(f"""select doc_id, case when regexp_matches(lower(p), '[.]tar[.]gz$') then 'gz' when regexp_matches(lower(p), '[.]tar[.]bz2$') then 'bz2' when regexp_matches(lower(p), '[.]tar[.]xz$') then 'xz'
    when regexp_matches(lower(p), '[.]tar[.]zst$') then 'zst' else 'unknown' end as format from (select doc_id, 'd/' || doc_id || [{', '.join(f"'{a}'" for a in _SUFFIXES)}][doc_id % {len(_SUFFIXES)} + 1] as p from documents)""")
def q07_compound_suffix(spark, sf_dir):
    suffix = F.get(F.array(*map(F.lit, _SUFFIXES)), F.pmod("doc_id", F.lit(len(_SUFFIXES))).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", scalar.container_format(F.lit("application/octet-stream"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), suffix)).alias("format"))


@query(f"with {_PAGE_FILES} select page_id, mime, processor, priority from files join {_PROC_MIMES} on mime = pmime where mime != ''")
def q08_registry_by_mime(spark, sf_dir):
    return lookup.by_mime(_page_files(spark, sf_dir)).select("page_id", "mime", "processor", "priority")


_FALLBACK = f"""{_PAGE_FILES}, bm as (select page_id, path, processor, priority from files join {_PROC_MIMES} on mime = pmime where mime != ''),
    be as (select page_id, path, processor, priority from files f join {_PROC_EXTS} on {_PAGE_EXT} = pext where not exists (select 1 from bm where bm.page_id = f.page_id)),
    found as (select * from bm union all select * from be)"""


@query(f"with {_FALLBACK} select page_id, processor, priority from found")
def q09_registry_fallback(spark, sf_dir):
    return lookup.supported(_page_files(spark, sf_dir)).select("page_id", "processor", "priority")


@query(f"with {_FALLBACK} select page_id, path, 'Unsupported format' as reason from files where page_id not in (select page_id from found)")
def q10_unsupported_anti(spark, sf_dir):
    return lookup.unsupported(_page_files(spark, sf_dir)).select("page_id", "path", "reason")


@query(f"with {_FALLBACK} select page_id, processor from (select *, row_number() over (partition by page_id order by priority) r from found) where r = 1")
def q11_primary_processor(spark, sf_dir):
    return lookup.primary(_page_files(spark, sf_dir)).select("page_id", "processor")


@query("select conv_id, (row_number() over (partition by conv_id order by turn, role) - 1)::int as pos, role as member from conversations")
def q12_expand_members(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return expand.members(c, "conv_id", "turn", "role")


@query("""with recursive e as (select 'r' || r_regionkey as parent_id, 'n' || n_nationkey as child_id from region join nation on n_regionkey = r_regionkey
        union all select 'n' || c_nationkey, 'c' || c_custkey from customer),
    t as (select 'r' || r_regionkey as root, 'r' || r_regionkey as node, 0 as depth from region union all select root, child_id, depth + 1 from t join e on node = parent_id)
    select root, depth, count(*) as nodes from t group by root, depth""")
def q13_recursive_expand(spark, sf_dir):
    r, n, c = (_t(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    tag = lambda t, col: F.concat(F.lit(t), F.col(col).cast("string"))
    edges = n.select(tag("r", "n_regionkey").alias("parent_id"), tag("n", "n_nationkey").alias("child_id")).unionAll(c.select(tag("n", "c_nationkey"), tag("c", "c_custkey")))
    return expand.descend(edges, r.select(tag("r", "r_regionkey").alias("node"))).groupBy("root", "depth").agg(F.count("*").alias("nodes"))


_STEPS = [lambda c: F.regexp_replace(c, "[*%&$#!]+", ""), lambda c: F.regexp_replace(c, "[ \t]+", " "), F.trim]


@query("select doc_id, nullif(length(trim(regexp_replace(regexp_replace(text, '[*%&$#!]+', '', 'g'), '[ \t]+', ' ', 'g'))), 0) as size from documents")
def q14_pipe_fold(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(select.pipe(F.col("text"), _STEPS)).cast("bigint").alias("size"))


_CANDIDATES_SQL = """c as (select page_id, url, strlen(html) as original, strlen(html) + 16 as s0, strlen(regexp_replace(html, '<!--.*?-->', '', 'g')) as s1, strlen(regexp_replace(html, '[*%&$#]{3}', '', 'g')) as s2 from pages),
    b as (select page_id, url, original, least(s0, s1, s2) as size, case when s0 <= s1 and s0 <= s2 then 0 when s1 <= s2 then 1 else 2 end as idx from c)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = [F.octet_length("html") + 16, F.octet_length(F.regexp_replace("html", "<!--.*?-->", "")), F.octet_length(F.regexp_replace("html", "[*%&$#]{3}", ""))]
    return _t(spark, sf_dir, "pages").select("page_id", "url", F.octet_length("html").cast("bigint").alias("original"), F.array(*[s.cast("bigint") for s in sizes]).alias("sizes"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    best = select.best_of([F.col("sizes")[i] for i in range(3)])
    return rows.withColumn("b", best).select("page_id", "url", "original", F.col("b.size").alias("size"), F.col("b.idx").alias("idx"))


@query(f"with {_CANDIDATES_SQL} select page_id, size, idx from b")
def q15_parallel_argmin(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select(F.col("page_id").alias("path"), F.posexplode("sizes").alias("idx", "size")).withColumn("success", F.lit(True))
    return select.best_candidate(rows).select(F.col("path").alias("page_id"), "size", "idx")


@query(f"with {_CANDIDATES_SQL} select page_id, original, size from b where size > 0 and size < original")
def q16_size_gate(spark, sf_dir):
    return _best(spark, sf_dir).where(select.accepted(F.col("size"), F.col("original"))).select("page_id", "original", "size")


@query(f"""with {_CANDIDATES_SQL} select page_id, case when page_id % 9 = 0 then '{select.UNSUPPORTED}' when page_id % 9 = 1 then '{select.FAILED}' when size >= original then '{select.NO_GAIN}'
    when page_id % 9 = 2 then '{select.CORRUPT}' end as reason from b""")
def q17_gate_reason(spark, sf_dir):
    k = F.pmod("page_id", F.lit(9))
    return _best(spark, sf_dir).select("page_id", select.gate_reason(k != 0, F.when(k == 1, 0).otherwise(F.col("size")), F.col("original"), k != 2).alias("reason"))


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn desc)::int as pop from conversations")
def q18_finalize_lifo(spark, sf_dir):
    return order.lifo(_t(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("select conv_id, sha256(string_agg(text, chr(10) order by turn)) as content, count(*) as n_members from conversations group by conv_id")
def q19_repack_concat(spark, sf_dir):
    out = expand.reassemble(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "\n")
    return out.withColumn("content", F.sha2("content", 256))


_RESULTS_SQL = f"{_CANDIDATES_SQL}, results as (select url as path, page_id, original as size_before, size as size_after, page_id % 11 != 0 as success, page_id % 11 != 0 and size < original as replaced from b)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.pmod("page_id", F.lit(11)) != 0
    return _best(spark, sf_dir).select(F.col("url").alias("path"), "page_id", F.lit("text/html").alias("mime"), F.col("original").alias("size_before"), F.col("size").alias("size_after"), ok.alias("success"), (ok & (F.col("size") < F.col("original"))).alias("replaced"))


@query(f"""with {_RESULTS_SQL}, t as (select count(*) as n_files, sum(size_before)::bigint as original, coalesce(sum(size_before - size_after) filter (where replaced and size_before > size_after), 0)::bigint as saved from results)
    select n_files, original, saved, case when original > 0 then 100.0::double * saved / original else 0 end as reduction_pct from t""")
def q20_totals(spark, sf_dir):
    return report.totals(_results(spark, sf_dir))


@query(f"""with {_RESULTS_SQL} select path, 'text/html' as mime, size_before // 1024 as before_kb, size_after // 1024 as after_kb,
    case when success and size_before > 0 then 100.0::double * (1.0::double - size_after / size_before) else 0.0::double end as delta_pct,
    case when not success then 'FAIL' when replaced then 'OK (replaced)' else 'OK (skipped)' end as result from results""")
def q21_report_rows(spark, sf_dir):
    return report.report_rows(_results(spark, sf_dir))


@query(f"with {_RESULTS_SQL} select greatest(15, max(length(path)))::int as path_width, greatest(10, max(length(size_before::varchar)))::int as size_before_width from results")
def q22_column_widths(spark, sf_dir):
    return report.widths(_results(spark, sf_dir), {"path": "path", "size_before": "before"})


@query("select count(*) filter (where event_type = 'view') as total, count(*) filter (where event_type = 'click') as done from events")
def q23_progress_counts(spark, sf_dir):
    return report.progress(_t(spark, sf_dir, "events"), "event_type", "view", "click")


@query("""select source, doc_id, row_number() over (partition by source order by lang, doc_id)::int as rank from documents""")
def q24_natural_sort_key(spark, sf_dir):
    # names such as p10en2.txt: letters, then numbers without leading zeros, by value
    rows = _t(spark, sf_dir, "documents").select("source", "doc_id", F.concat("lang", F.lit("-p"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    return order.natural_rank(rows, "source", "name").drop("name")


@query("select conv_id, turn, row_number() over (partition by conv_id order by case when role = 'assistant' then 0 else 1 end, turn)::int as place from conversations")
def q25_special_first(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return order.special_first(c, "conv_id", F.col("role") == "assistant", "turn").drop("role")


@query("select doc_id, min(doc_id) over (partition by sha256(text)) as target from documents")
def q26_hardlink_first(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return lookup.link_targets(d, ["h"], "doc_id", "doc_id").select("doc_id", "target")


@query("""select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is null or b != event_type""")
def q27_adjacent_unique(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return order.adjacent_unique(e, "user_id", ["ts", "event_id"], "event_type").drop("ts")


_PIXELS_SQL = """px as (select vec_id as image_id, i, (floor((embedding[i + 1] + 1) * 7.9))::int as r, (floor((embedding[i + 2] + 1) * 7.9))::int as g, (floor((embedding[i + 3] + 1) * 7.9))::int as b, case when vec_id % 3 = 0 then 255 else 200 + i % 2 end as a
    from embeddings, (select unnest(range(0, 64, 4)) as i))"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    cell = lambda n: F.floor((F.get("embedding", F.col("i") + n) + F.lit(1)) * F.lit(7.9)).cast("int")
    rows = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(4))).alias("i"))
    return rows.select(F.col("vec_id").alias("image_id"), cell(0).alias("r"), cell(1).alias("g"), cell(2).alias("b"), F.when(F.pmod("vec_id", F.lit(3)) == 0, 255).otherwise(200 + F.col("i") % 2).alias("a"))


@query(f"""with {_PIXELS_SQL}, s as (select image_id, count(*) as n_pixels, bool_and(r = g and g = b) as all_gray, bool_and(a = 255) as all_opaque, count(distinct (r, g, b, a)) as n_colours from px group by image_id)
    select *, case when n_colours <= 256 then 'palette' when all_gray and all_opaque then 'gray' when all_gray then 'gray_alpha' when all_opaque then 'rgb' else 'rgba' end as colour_type from s""")
def q28_colour_stats(spark, sf_dir):
    return raster.colour_stats(_pixels(spark, sf_dir))


@query("select event_type, first_position, (row_number() over (order by first_position) - 1)::int as idx from (select event_type, min(event_id) as first_position from events group by event_type)")
def q29_dictionary_index(spark, sf_dir):
    return order.dictionary(_t(spark, sf_dir, "events"), "event_type", "event_id")


_SEGMENTS_SQL = """g as (select event_id, user_id, ts, value, case when date_diff('microsecond', lag(ts) over w, ts) > 1800000000 then 1 else 0 end as f from events window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(f) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as seg from g)"""


@query(f"with {_SEGMENTS_SQL} select user_id, seg, min(ts) as starttime, max(ts) as endtime, count(*) as samplecnt from s group by user_id, seg")
def q30_series_segments(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return series.summaries(series.segments(e, "user_id", "ts", 1800.0, "event_id"), "user_id", "ts")


@query("""select user_id, count(*) as n, bool_and(coalesce(not abs(value - v2) > abs(value) * 1e-6, false)) as equal from (select user_id, value, case when event_id % 1000 = 7 then value + 1 else value * (1 + 1e-9) end as v2 from events) group by user_id""")
def q31_series_equal(spark, sf_dir):
    a = _t(spark, sf_dir, "events").select("user_id", "event_id", "value")
    b = a.withColumn("value", F.when(F.pmod("event_id", F.lit(1000)) == 7, F.col("value") + 1).otherwise(F.col("value") * (1 + 1e-9)))
    return series.equal_within(a, b, "user_id", ["event_id"], "value", series.TOLERANCE["f"])


@query("select event_id, case when event_id % 2 = 1 then 131072 else 256 end as reclen from events")
def q32_record_len(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", scalar.record_length(F.pmod("event_id", F.lit(2)) + 2, F.lit("i"), F.col("event_id")).alias("reclen"))


@query("""with a as (select sha256(text) as h from documents), b as (select sha256(case when doc_id % 50 = 0 then text || '!' else text end) as h from documents)
    select h, 'left' as side from (select h from a except all select h from b) union all select h, 'right' from (select h from b except all select h from a)""")
def q33_raw_equal_sets(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    changed = F.when(F.pmod("doc_id", F.lit(50)) == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return lookup.same_rows(d.select(F.sha2("text", 256).alias("h")), d.select(F.sha2(changed, 256).alias("h")))


@query("""select doc_id, md5(case when regexp_matches(text, '[,"\n\r]') then '"' || replace(text, '"', '""') || '"' else text end) as cell from documents""")
def q34_csv_escape(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(scalar.csv_escape(F.col("text"))).alias("cell"))


@query("select page_id, case when length(url) <= 40 then url else substr(url, 1, 37) || '...' end as name from pages")
def q35_truncate_name(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", scalar.truncated(F.col("url"), 40).alias("name"))


_MEMBER = "case page_id % 5 when 0 then '../' || page_id when 1 then '/abs/' || page_id when 2 then 'a/./b//' || page_id when 3 then 'a\\' || page_id || '\\..\\c' else 'a/../../' || page_id end"


@query("select page_id, case page_id % 5 when 1 then 'abs/' || page_id when 2 then 'a/b/' || page_id when 3 then 'a/c' end as safe from pages")
def q36_zip_slip(spark, sf_dir):
    k, p = F.pmod("page_id", F.lit(5)), F.col("page_id").cast("string")
    member = F.when(k == 0, F.concat(F.lit("../"), p)).when(k == 1, F.concat(F.lit("/abs/"), p)).when(k == 2, F.concat(F.lit("a/./b//"), p)).when(k == 3, F.concat(F.lit("a\\"), p, F.lit("\\..\\c"))).otherwise(F.concat(F.lit("a/../../"), p))
    return _t(spark, sf_dir, "pages").select("page_id", scalar.safe_member_path(member).alias("safe"))


@query("""select o_orderkey as path, coalesce(f, floor(o_totalprice)::bigint) as size_after from (select *, (select sum(l_quantity)::bigint from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as f from orders)""")
def q37_report_upsert(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.floor("o_totalprice").cast("bigint").alias("size_after"))
    f = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("path")).agg(F.sum("l_quantity").cast("bigint").alias("final_size"))
    return lookup.upsert(o, f)


@query("select page_id, 'png:' || (page_id % 7) || '.00% -> zopflipng:' || (page_id % 13) || '.50%' as trail from pages")
def q38_codec_trail(spark, sf_dir):
    codecs = F.array(F.struct(F.lit("png").alias("name"), F.pmod("page_id", F.lit(7)).cast("double").alias("pct")), F.struct(F.lit("zopflipng").alias("name"), (F.pmod("page_id", F.lit(13)) + F.lit(0.5)).cast("double").alias("pct")))
    return _t(spark, sf_dir, "pages").select("page_id", scalar.codec_trail(codecs, "pipe").alias("trail"))


@query("select doc_id, len(string_split(text, chr(10))) as n_lines, len(list_distinct(string_split(text, chr(10)))) as n_kept from documents")
def q39_line_dedupe_encoder(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.size(F.array_distinct(lines)).cast("bigint").alias("n_kept"))


@query("""select event_id, floor((20000000000 - (event_id + 1)) / ((event_id + 1) / (event_id % 97 + 1)::double))::bigint as eta from events""")
def q40_eta(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", scalar.eta_seconds(F.col("event_id") + 1, F.lit(20_000_000_000), (F.pmod("event_id", F.lit(97)) + 1).cast("double")).cast("bigint").alias("eta"))


@query()
def q41_codec_sizes(spark, sf_dir):
    from .codecs.general import compressed_sizes

    # encoders take far longer than a shuffle of the texts, and a row group is read by one task
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = docs.select("doc_id", compressed_sizes(F.col("text").cast("binary")).alias("sizes"))
    best = sizes.select("doc_id", select.best_of([F.get("sizes", F.lit(i)) for i in range(3)]).alias("b"))
    return best.select("doc_id", "b.size", "b.idx")


@query("select conv_id::varchar as parent_id, (row_number() over (partition by conv_id order by turn) - 1)::int as seq, 'turn' || turn || '.txt' as rel_path, strlen(text) as size from conversations")
def q42_unzip_members(spark, sf_dir):
    from .codecs.containers import pack, unpack

    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("parent_id"), F.col("turn").cast("int").alias("seq"), F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".txt")).alias("rel_path"), F.col("text").cast("binary").alias("content"))
    packed = pack(c.withColumn("format", F.lit("zip")))
    return unpack(packed).select("parent_id", "seq", "rel_path", F.octet_length("content").cast("bigint").alias("size"))


@query("select n_nationkey as path, true as smaller, true as equal from nation")
def q43_sqlite_vacuum(spark, sf_dir):
    from .codecs.sqlite import sample_database, vacuum

    made = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("path"), sample_database(F.col("n_nationkey")).alias("content"))
    return made.select("path", F.octet_length("content").alias("before"), vacuum(F.col("content")).alias("r")).select("path", (F.octet_length("r.content") < F.col("before")).alias("smaller"), "r.equal")


@query(f"""with {_SEGMENTS_SQL} select user_id, min(ts) as starttime, max(ts) + interval 30 minute as endtime, count(*) as n from s group by user_id, seg""")
def q44_stream_sessions(spark, sf_dir):
    from .streaming.sessions import finished_sessions

    local = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return finished_sessions(spark, sf_dir, "events.parquet", gap="30 minutes").select("user_id", local("starttime"), local("endtime"), "n")


@query("""select lang, count(*) as n, sum(strlen(text))::bigint as bytes from documents group by lang""")
def q45_scan_totals(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))


@query(f"""with {_CANDIDATES_SQL} select page_id, case when size > 0 and size < original then size else original end as final_size, idx from b""")
def q46_engine_flagship(spark, sf_dir):
    b = _best(spark, sf_dir)
    return b.select("page_id", F.when(select.accepted(F.col("size"), F.col("original")), F.col("size")).otherwise(F.col("original")).alias("final_size"), "idx")


@query("select doc_id, lower(md5(text)) as digest from documents")
def q47_digest_hex(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(F.unhex(F.md5("text")))).alias("digest"))


@query("""select event_id, (((event_id % 256) << 24) | ((event_id % 7) << 16) | ((event_id % 5) << 8) | 255)::bigint as rgba, ceil(log2(event_id + 1))::bigint as bits from events""")
def q48_pack_rgba(spark, sf_dir):
    n = F.col("event_id")
    return _t(spark, sf_dir, "events").select("event_id", scalar.pack_rgba(F.pmod(n, F.lit(256)), F.pmod(n, F.lit(7)), F.pmod(n, F.lit(5)), F.lit(255)).alias("rgba"), scalar.ceil_log2(n + 1).cast("bigint").alias("bits"))


from . import byte_queries  # noqa: E402, F401
