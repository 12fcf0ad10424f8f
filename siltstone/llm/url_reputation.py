"""Host reputation by empirical Bayes, with rules that go before it.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. Each level is a beta-binomial whose
prior mean is the posterior mean of the level above (all pages, suffix, domain, host) and whose strength is estimated from how
much the rates of that level differ more than chance explains (method of moments). A page is blocked if the lower bound of its
host's posterior bad rate exceeds a limit: few labels leave a host near its domain, and far from certain.

Pages are pre-aggregated to hosts before any shuffle by host, and rows of pages meet one row per host, so a host with a third of
all pages is an ordinary skewed join that Spark splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BAD = 0.5
Z = 1.645

#: Labels under which countries register domains: with a country's two letters they make a suffix of two labels. Fixed values.
COUNTRY_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
_TWO_LABELS = rf"^({'|'.join(COUNTRY_LABELS)})\.[a-z][a-z]$"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct<rule, action> of the longest fitting rule; both null if none fits. Equal lengths: the first given."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


def suffix_of(host: Column, more: tuple[str, ...] = ()) -> Column:
    """The public suffix of a host without port and user: a label of COUNTRY_LABELS with a country, else the last label; the host itself if it
    is a number address or one label. ``more`` names further suffixes, of two or three labels, that hold sites of many owners."""
    three, two = (F.regexp_extract(host, rf"((?:[^.]+\.){{{n}}}[^.]+)$", 1) for n in (2, 1))
    known = F.when(three.isin(*[m for m in more if m.count(".") == 2]), three).when(two.isin(*[m for m in more if m.count(".") == 1]), two) if more else F.lit(None).cast("string")
    return F.when(host.rlike(r"^[0-9.]+$|^\[|^[^.]*$"), host).otherwise(F.coalesce(known, F.when(two.rlike(_TWO_LABELS), two), F.regexp_extract(host, r"([^.]+)$", 1)))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with one more label, where the host has one."""
    rest = F.expr("substring({h}, 1, length({h}) - length({s}) - 1)".format(h="bare", s="suffix"))
    return F.when(host == suffix, host).otherwise(F.concat(F.regexp_extract(rest, r"([^.]+)$", 1), F.lit("."), suffix))


def _strength(groups: DataFrame) -> float:
    """The prior strength of a level from its groups' n and bad, by moments; between 1 and 1000."""
    t = groups.where("n > 0").agg(F.count("*").alias("g"), F.sum("n").alias("t"), F.sum("bad").alias("k"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("r"))
    p = F.col("k") / F.nullif(F.col("t"), F.lit(0))
    between = F.col("r") - F.col("t") * p * p
    v = p * (1 - p)
    chance = v * (F.col("t") - F.col("q") / F.nullif(F.col("t"), F.lit(0)) - (F.col("g") - 1))
    rho = (between - v * (F.col("g") - 1)) / F.nullif(chance, F.lit(0.0))
    rho = F.greatest(F.lit(0.000999000999000999), F.least(F.lit(0.5), F.coalesce(F.when(F.col("g") > 1, rho), F.lit(0.0))))
    # no prior is stronger than the labels that it comes from
    return t.select(F.least((1 - rho) / rho, F.coalesce("t", F.lit(0)) + F.lit(2.0)).alias("s")).first()["s"]


def host_reputation(outcomes: DataFrame, hosts: DataFrame, z: float = Z, more_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """One row per host: host, domain, suffix, n, bad, bad_mean, bad_bound (the lower one).

    ``hosts`` has the hosts to judge in column host; ``outcomes`` has host and bad (0 or 1), a row for each label. Counts of hosts are written
    once; the prior mean of all pages and the strength of each level are four numbers, read by the driver.

    Cases: a null host is left out, an empty one is a host; outcomes of null count for nothing; repeated hosts count once, repeated outcomes each.
    Without outcomes all hosts have the mean one half. Empty tables give an empty result.
    """
    counted = outcomes.where("host is not null").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("bad"))
    h = hosts.where("host is not null").select("host").distinct().join(counted, "host", "full_outer").fillna(0, ["n", "bad"])
    h = h.withColumn("bare", F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")).withColumn("suffix", suffix_of(F.col("bare"), more_suffixes))
    h = written(h.withColumn("domain", domain_of(F.col("bare"), F.col("suffix"))).drop("bare"))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = h.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    top = h.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m")).first()["m"]

    def shrunk(strength: float, mean: Column) -> Column:
        return (F.lit(strength) * mean + F.col("bad")) / (F.lit(strength) + F.col("n"))

    own = _strength(h)
    s = suffixes.select("suffix", shrunk(_strength(suffixes), F.lit(top)).alias("m1"))
    d = domains.join(s, "suffix").select("domain", "suffix", shrunk(_strength(domains), F.col("m1")).alias("m2"))
    out = h.join(d, ["domain", "suffix"]).withColumn("bad_mean", shrunk(own, F.col("m2")))
    sd = F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.lit(own) + F.col("n") + 1))
    return out.withColumn("bad_bound", F.greatest(F.lit(0.0), F.col("bad_mean") - z * sd)).select("host", "domain", "suffix", "n", "bad", "bad_mean", "bad_bound")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, max_bad: float = MAX_BAD, z: float = Z, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean, bad_bound.

    ``labels`` has doc_id, quality and toxic; a label belongs to the page with that id and is bad if quality is 0 or toxic is 1.
    Labels with neither take no part; several labels of a page all count.

    Cases: a null url, or one without ``://``, has empty host and path, which share one reputation. Repeated pages repeat; a null
    page_id stays. Without labels nothing but rules blocks. Other columns are not read. An empty table gives an empty result.
    """
    url = F.col(url_col)
    p = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    marks = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad is not null")
    found = host_reputation(p.join(marks, "page_id").select("host", "bad"), p.select("host"), z)
    ruled = p.join(found.select("host", "bad_mean", "bad_bound"), "host", "left").withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.action"), F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "bad_mean", "bad_bound")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def judge_sql(rules: tuple[Rule, ...] = RULES, max_bad: float = MAX_BAD, z: float = Z) -> str:
    """The same in DuckDB's SQL, over the tables pages and labels."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    fits = lambda r: f"(host = {_quoted(r.host)} or ends_with(host, {_quoted('.' + r.host)})) and starts_with(path, {_quoted(r.path)})"
    rule = "case " + " ".join(f"when {fits(r)} then {_quoted(r.text)}" for r in ordered) + " end"
    action = "case " + " ".join(f"when {fits(r)} then {_quoted(r.action)}" for r in ordered) + " end"

    def strength(level: str) -> str:
        return f"""select least((1 - rho) / rho, coalesce(t, 0) + 2.0::double) as s from (select t, greatest(0.000999000999000999, least(0.5, coalesce(case when g > 1 then
            (r - t * (k / t) * (k / t) - (k / t) * (1 - k / t) * (g - 1)) / nullif((k / t) * (1 - k / t) * (t - q / t - (g - 1)), 0) end, 0))) as rho
            from (select count(*)::double g, sum(n)::double t, sum(bad)::double k, sum(n * n)::double q, sum(bad * bad / n::double) r from {level} where n > 0))"""

    return f"""with p as (select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
        marks as (select doc_id as page_id, case when quality = 0 or toxic = 1 then 1 else 0 end as bad from labels where quality is not null or toxic is not null),
        c as (select host, count(*) n, sum(bad)::bigint bad from p join marks using (page_id) group by host),
        h0 as (select host, coalesce(n, 0) n, coalesce(bad, 0) bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') bare from (select distinct host from p) left join c using (host)),
        h1 as (select *, case when regexp_matches(bare, '^[0-9.]+$|^\\[|^[^.]*$') then bare when regexp_matches(regexp_extract(bare, '([^.]+\\.[^.]+)$', 1), {_quoted(_TWO_LABELS)}) then regexp_extract(bare, '([^.]+\\.[^.]+)$', 1) else regexp_extract(bare, '([^.]+)$', 1) end as suffix from h0),
        h as (select host, n, bad, suffix, case when bare = suffix then bare else regexp_extract(substring(bare, 1, length(bare) - length(suffix) - 1), '([^.]+)$', 1) || '.' || suffix end as domain from h1),
        d as (select domain, suffix, sum(n)::bigint n, sum(bad)::bigint bad from h group by all),
        x as (select suffix, sum(n)::bigint n, sum(bad)::bigint bad from d group by all),
        m0 as (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2)::double as m0 from x),
        m1 as (select suffix, (s * m0 + bad) / (s + n) as m1 from x, m0, ({strength('x')})),
        m2 as (select domain, suffix, (s * m1 + bad) / (s + n) as m2 from d join m1 using (suffix), ({strength('d')})),
        m3 as (select host, s, n, (s * m2 + bad) / (s + n) as bad_mean from h join m2 using (domain, suffix), ({strength('h')})),
        m as (select host, bad_mean, greatest(0.0, bad_mean - {z} * sqrt(bad_mean * (1 - bad_mean) / (s + n + 1))) as bad_bound from m3)
        select page_id, host, path, {rule} as rule, coalesce({action}, case when bad_bound > {max_bad} then 'block' else 'allow' end) as verdict, bad_mean, bad_bound from p left join m using (host)"""
