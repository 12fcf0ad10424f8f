"""The queries of this subpackage, by name, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, dart_minhash, langid, line_dedup, packing, pii, spotsigs, token_counts, url_reputation, vptree
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op5_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.search(vptree.build_index(vectors), vectors.where(F.col("vec_id") % 100 == 0))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False, added_tokens=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(table(spark, sf_dir, "documents"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encoded_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_langid, op3_dart_minhash, op4_line_dedup, op5_vptree, op6_packing, op7_token_counts, op8_spotsigs, op9_url_reputation, op10_bpe_tree)}


def _nearest_sql() -> str:
    return """with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0),
        d as (select q.vec_id as query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) as score
            from v q join v c on q.vec_id != c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
        r as (select *, row_number() over (partition by query_id order by score, vec_id)::int as rank from d)
        select query_id, rank, vec_id, score from r where rank <= 10"""


def _classes_sql() -> str:
    """Near-duplicate classes by all pairs that share a shingle; for small tables."""
    blank = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    n = dart_minhash.WIDTH
    return f"""with recursive d as (select doc_id, min(coalesce(text, '')) over (partition by doc_id) as text from documents where doc_id is not null),
        h as (select text, min(doc_id) as node from d group by text),
        l as (select node, list_filter(string_split_regex(lower(text), '{blank}'), lambda x: x != '') as w from h),
        s as (select node, unnest(list_transform(range(greatest(len(w) - {n - 1}, 1)), lambda i: array_to_string(w[i + 1:i + {n}], ' '))) as g from l where len(w) > 0),
        c as materialized (select node, g, count(*) as n from s group by node, g),
        t as (select node, sum(n) as n from c group by node),
        o as (select a.node as x, b.node as y, sum(least(a.n, b.n)) as n from c a join c b on a.g = b.g and a.node < b.node group by a.node, b.node),
        k as materialized (select x, y from o join t u on u.node = x join t v on v.node = y where o.n >= {dart_minhash.THRESHOLD} * (u.n + v.n - o.n) - 1e-9),
        e as materialized (select x, y from k union all select y, x from k),
        r(node, root) as (select node, node from h union select e.y, r.root from r join e on e.x = r.node where r.root < e.y),
        m as (select node, min(root) as root from r group by node)
        select documents.doc_id, m.root as class_id from documents left join d on d.doc_id = documents.doc_id left join h on h.text = d.text left join m on m.node = h.node"""


ORACLE_SQL = {"op3_dart_minhash": _classes_sql(), "op4_line_dedup": line_dedup.line_report_sql(), "op5_vptree": _nearest_sql(), "op8_spotsigs": spotsigs.compare_edited_sql(), "op9_url_reputation": url_reputation.judge_sql()}
