"""Document fingerprints by spot signatures.

An anchor is a very common word. Each anchor in a text, with the chain of content words (words that are no anchors) that follow
it, is a signature; the set of a text's signatures is its fingerprint. Chains tie a text's running prose, so menus and
boilerplate without common words leave few traces. Two fingerprints are compared by Jaccard, which can't exceed the ratio of their
sizes: sets fall into partitions by size, and pairs whose partitions lie too far apart, or whose sizes rule out the threshold,
are never intersected.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import dart_minhash
from .common import forget, whole_text, written

#: Common words of English, German, French and Spanish. Fixed values.
ANCHORS = (
    "a an and are as at be by for from had has have he her his in is it not of on or that the this to was were which with "
    "aber als am auf aus bei das dem den der des die ein eine er es für hat im ist mit nicht sich sie sind und von war wie zu "
    "au aux avec ce cette dans de du elle en est et il la le les leur mais ne nous ou par pas pour que qui sa se ses son sur un une "
    "al como con del el ella entre esta este fue hay las lo los más muy no o para pero por se si sin su sus una y"
).split()
CHAIN = 2
BUCKET_ROWS = 1000
MAX_BUCKETS = 10_000
PARTS = 64


def _hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def with_fingerprint(rows: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Adds the sorted array of the distinct signatures of column ``text``. Signatures have 60 bits, the first of an MD5; a text without any
    is told by two such hashes of all its words or, if it has none, of itself."""
    anchors = sorted(set(ANCHORS))
    step = rows.withColumn("_words", F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", -1), lambda w: w != ""))
    step = step.withColumn("_content", F.filter("_words", lambda w: ~w.isin(*anchors)))
    step = step.withColumn("_spots", F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: s["w"].isin(*anchors)))
    # before the j-th anchor, at word i, there are i - j content words
    chains = F.transform("_spots", lambda s, j: F.when(F.get(F.col("_content"), s["i"] - j).isNotNull(), _hash(F.concat_ws(" ", s["w"], *[F.get(F.col("_content"), s["i"] - j + n) for n in range(chain)]))))
    found = F.array_distinct(F.filter(chains, lambda h: h.isNotNull()))
    whole = lambda n: F.when(F.size("_words") > 0, _hash(F.concat(F.lit(f"words{n} "), F.array_join("_words", " ")))).otherwise(_hash(F.concat(F.lit(f"text{n} "), F.col(text))))
    step = step.withColumn("_found", found)
    return step.withColumn(out, F.array_sort(F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(whole(1), whole(2))))).drop("_words", "_content", "_spots", "_found")


def jaccard(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard of two arrays of distinct signatures; with a threshold, 0 where the sizes alone rule it out, without intersecting."""
    both = F.size(F.array_intersect(a, b))
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    value = F.when(a == b, F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))
    return value if not threshold else F.when(small < threshold * large, F.lit(0.0)).otherwise(value)


def size_partition(signature: Column, threshold: float) -> Column:
    """The partition of a set by its size: sets that reach the threshold lie in the same or in neighbouring partitions."""
    return F.floor(F.log(F.size(signature).cast("double")) / F.lit(math.log(1 / threshold)) + 1e-9)


def similar_pairs(pairs: DataFrame, a: str, b: str, threshold: float = 0.8) -> DataFrame:
    """The rows whose fingerprints in columns ``a`` and ``b`` reach the threshold, with their likeness; pruned by partition, then size. Pairs with a
    null fingerprint go; repeated pairs repeat; an empty table gives an empty result."""
    near = F.abs(size_partition(F.col(a), threshold) - size_partition(F.col(b), threshold)) <= 1
    return pairs.where(near).withColumn("likeness", jaccard(F.col(a), F.col(b), threshold)).where(F.col("likeness") >= threshold)


def _compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Adds to pairs (a, b): linked, na, nb (sizes), and difference, the signatures of only one of both. A centre's pairs are dealt to parts."""
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(PARTS)).alias("part"))
    left = dealt.select("a", "part").distinct().join(sets.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a")
    both = dealt.join(sets.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b").join(left, ["a", "part"])
    difference = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    return both.select("a", "b", (jaccard(F.col("x"), F.col("y"), threshold) >= threshold - 1e-12).alias("linked"), F.size("x").cast("bigint").alias("na"), F.size("y").cast("bigint").alias("nb"), difference.alias("difference"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id and class_id of each row: the least doc_id among the documents that links of at least the threshold join.

    Sets fall into partitions by length; a set's rarest signatures, as many as two similar sets can't both lack, are its entries in the index
    of its own partition and of the next one. Sets that share an entry are compared with one centre for each entry, sizes before contents, and what is
    not linked to a centre as in dart_minhash, so a group of copies never forms all its pairs.

    Cases: texts of equal fingerprints are of one class, so null and empty texts are; rows that share a doc_id count as one document. A null doc_id has no
    class (null) and takes no part. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    # a node is a fingerprint, told by its hash
    found = written(with_fingerprint(rows, "text", "sig").select("doc_id", "sig", F.xxhash64("sig").alias("node")))
    named = found.where("doc_id is not null")
    sets = written(named.groupBy("node").agg(F.min("sig").alias("sig")).withColumn("n", F.size("sig")).withColumn("p", size_partition(F.col("sig"), threshold)))
    spread = sets.select("node", "n", "p", F.explode("sig").alias("cell"))
    ranked = spread.join(spread.groupBy("cell").agg(F.count("*").alias("df")).where("df > 1"), "cell", "left")
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "cell"))).where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & F.col("df").isNotNull())
    entries = ranked.select("node", F.explode(F.array(F.xxhash64("cell", "p"), F.xxhash64("cell", F.col("p") + 1))).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(entries.join(shared, "bucket"))
    spokes = written(dart_minhash._stars(buckets))
    stars = written(_compared(spokes, sets, threshold))
    pairs = written(dart_minhash._others(stars, threshold))
    more = written(_compared(pairs, sets, threshold).select("a", "b", "linked"))
    links = stars.where("linked").select("a", "b").union(more.where("linked").select("a", "b"))
    # rows of one doc_id are tied together
    least = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    ties = named.join(least.select("doc_id", "a"), "doc_id").where("node != a").select("a", F.col("node").alias("b")).distinct()
    labels = dart_minhash.components(links.union(ties))
    forget(sets, buckets, spokes, stars, pairs, more)
    placed = written(found.select("doc_id", "node").join(labels.select("node", "root"), "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")))
    classes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return placed.join(classes, "root").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def _bucket(key: Column) -> Column:
    """How many of the sorted array bounds are at most the key, in two steps of about the root of their number; -1 for null."""
    skipped = F.size(F.filter("coarse", lambda b: b <= key)) * F.col("width")
    rest = F.size(F.filter(F.slice(F.col("bounds"), skipped + 1, F.col("width")), lambda b: b <= key))
    return F.when(key.isNull(), -1).otherwise(skipped + rest)


def with_next(rows: DataFrame, key: str, value: str, derive: Callable[[DataFrame], DataFrame], out: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds, for each column of ``out``, the same column of the next row as next_<column>, by descending key; after the last
    comes the first. Nulls come last, and equal keys are ordered by a hash of ``value``. ``rows`` has the integer key and the value;
    ``derive`` adds columns that depend on the value alone, once for each row, after the only shuffle of values.

    Rows fall into buckets by quantiles of the key; a key with more rows than a bucket should have, and null, make buckets of their own, cut by
    the hash. Each bucket is ordered by itself, and also gets the first row of the one that comes after it, so nothing is ordered
    in one task. Beyond MAX_BUCKETS * bucket_rows rows buckets grow; they are sorted and walked through with spilling.

    Cases: repeated rows follow each other; a single row is its own next; an empty table gives an empty result.
    """
    spark, rows = rows.sparkSession, rows.withColumn(key, F.col(key).cast("bigint"))
    n = rows.count()
    most = max(bucket_rows, -(-n // MAX_BUCKETS))
    buckets = max(1, -(-n // most))
    bounds = set(map(int, rows.where(F.col(key).isNotNull()).approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.1 / buckets))) if buckets > 1 else set()
    # fewer than MAX_BUCKETS keys have so many rows
    hot = [(r[key], -(-r.n // most)) for r in rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).collect()] if buckets > 1 else []
    for k, _ in hot:
        bounds |= {k, k + 1} if k is not None else set()
    bounds = sorted(bounds)
    width = max(1, math.isqrt(len(bounds)))
    parts = {k: p for k, p in hot if k is not None}
    fixed = spark.createDataFrame([(bounds, bounds[width - 1 :: width], width, list(parts), list(parts.values()))], "bounds array<bigint>, coarse array<bigint>, width int, hot array<bigint>, parts array<int>")
    share = (F.shiftrightunsigned(F.xxhash64(value), 11) / F.lit(float(1 << 53))).cast("double")
    null_parts = dict(hot).get(None, 1)
    many = F.when(F.col(key).isNull(), null_parts).otherwise(F.coalesce(F.try_element_at("parts", F.nullif(F.array_position("hot", F.col(key)), F.lit(0)).cast("int")), F.lit(1)))
    place = F.struct((-_bucket(F.col(key))).alias("b"), F.floor(share * many).cast("int").alias("p"))
    dealt = rows.crossJoin(F.broadcast(fixed)).select(key, value, F.xxhash64(value).alias("_h"), place.alias("_place"), F.lit(False).alias("_guest"))
    # one row per bucket, so they may meet in one task and be broadcast
    first = F.struct(F.coalesce(-F.col(key), F.lit(0)).alias("k"), F.shiftrightunsigned("_h", 1).alias("u"), F.col("_h").alias("h"))
    firsts = dealt.groupBy("_place").agg(F.min(first).alias("_first"))
    order = W.orderBy("_place")
    after = firsts.withColumn("_to", F.coalesce(F.lag("_place").over(order), F.max("_place").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    after = F.broadcast(after.select(F.col("_place").alias("_p"), F.col("_first.k").alias("_k"), F.col("_first.h").alias("_fh"), "_to"))
    meets = (F.col("_place") == F.col("_p")) & (F.coalesce(-F.col(key), F.lit(0)) == F.col("_k")) & (F.col("_h") == F.col("_fh"))
    guests = dealt.join(after, meets).groupBy("_to").agg(F.first(F.struct(key, value, "_h")).alias("_r"))
    guests = guests.select(F.col(f"_r.{key}").alias(key), F.col(f"_r.{value}").alias(value), F.col("_r._h").alias("_h"), F.col("_to").alias("_place"), F.lit(True).alias("_guest"))
    own = W.partitionBy("_place").orderBy("_guest", F.desc_nulls_last(key), F.shiftrightunsigned("_h", 1), "_h")
    both = derive(dealt.unionByName(guests).repartition("_place"))
    return both.select("*", *[F.lead(c).over(own).alias(f"next_{c}") for c in out]).where("not _guest").drop("_place", "_guest", "_h")


def spelled(signature: Column) -> Column:
    return F.array_join(signature.cast("array<string>"), " ")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document; the edited text's
    last third is the start of the next document, by descending id.

    Cases: a null text is empty. A text without anchors has two signatures of all its words, one without words two of itself, so equal
    texts always have equal fingerprints and likeness 1. A single document is its own next. Rows with one id are ordered by a hash of
    their texts; null ids come last. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    joined = with_next(rows, "doc_id", "text", lambda r: with_fingerprint(r, "text", "sig"), ["text", "sig"])
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    out = joined.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), "sig", "next_sig")
    out = with_fingerprint(out, "edited", "edited_sig")
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), spelled(F.col("sig")).alias("fingerprint"), spelled(F.col("edited_sig")).alias("edited_fingerprint"), jaccard(F.col("sig"), F.col("edited_sig")).alias("near_edited"), jaccard(F.col("sig"), F.col("next_sig")).alias("near_next"))


def compare_edited_sql() -> str:
    """The same in DuckDB's SQL over the table documents, whose doc_ids differ."""
    anchors = ", ".join(f"'{a}'" for a in sorted(set(ANCHORS)))
    hashed = lambda text: f"('0x' || substr(md5({text}), 1, 15))::bigint"
    return f"""with d as (select doc_id, coalesce(text, '') as text from documents),
        n as (select doc_id, text, length(text) as n_chars, coalesce(lead(text) over (order by doc_id desc nulls last), first_value(text) over (order by doc_id desc nulls last)) as next_text from d),
        e as (select *, substr(text, 1, n_chars - n_chars // 3) || substr(next_text, 1, n_chars // 3) as edited from n),
        t as (select doc_id, 'own' as side, text from e union all select doc_id, 'next', next_text from e union all select doc_id, 'edited', edited from e),
        l as (select doc_id, side, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') as words from t),
        u as (select doc_id, side, unnest(words) as w, unnest(range(len(words))) as i from l),
        k as (select *, w in ({anchors}) as anchor, sum(case when w in ({anchors}) then 0 else 1 end) over (partition by doc_id, side order by i) as c from u),
        c as (select doc_id, side, c, w from k where not anchor),
        s as (select distinct k.doc_id, k.side, {hashed("k.w || ' ' || a.w || coalesce(' ' || b.w, '')")} as h from k
            join c a on a.doc_id = k.doc_id and a.side = k.side and a.c = k.c + 1 left join c b on b.doc_id = k.doc_id and b.side = k.side and b.c = k.c + 2 where k.anchor),
        g as (select doc_id, side, list_sort(list(h)) as sig from s group by doc_id, side),
        f as (select l.doc_id, l.side, coalesce(g.sig, list_sort(case when len(words) > 0 then [{hashed("'words1 ' || array_to_string(words, ' ')")}, {hashed("'words2 ' || array_to_string(words, ' ')")}]
            else [{hashed("'text1 ' || text")}, {hashed("'text2 ' || text")}] end)) as sig from l left join g on g.doc_id = l.doc_id and g.side = l.side),
        p as (select doc_id, max(sig) filter (where side = 'own') as a, max(sig) filter (where side = 'edited') as b, max(sig) filter (where side = 'next') as c from f group by doc_id)
        select e.doc_id, n_chars, sha256(edited) as edited_sha256, array_to_string(a, ' ') as fingerprint, array_to_string(b, ' ') as edited_fingerprint,
            len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::double as near_edited, len(list_intersect(a, c)) / (len(a) + len(c) - len(list_intersect(a, c)))::double as near_next
        from e join p on p.doc_id = e.doc_id"""
