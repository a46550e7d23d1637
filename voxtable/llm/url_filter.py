"""URL filter: explicit rules first, then the reputation of the host.

Labelled page outcomes (bad or not) are summed by host, registered domain and suffix.
Each level's rate is shrunk towards its parent's by a beta-binomial prior whose strength
is estimated from the scatter of all its members (method of moments). A page is blocked
if the lower bound of its host's posterior rate of bad pages is above ``block_rate``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions.text import ascii_lower
from voxtable.plans.skew import skew_join
from voxtable.plans.storage import staged

BLOCK_RATE, Z = 0.25, 1.645
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
Rule = tuple[str, str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, URL, 1)), F.regexp_extract(u, URL, 2)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Rules: (verdict, host, path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(children: DataFrame) -> float:
    """Prior strength M of a level; ``children``: n, b and the parent's rate p."""
    q = F.col("p") * (1 - F.col("p"))
    r = children.agg(
        F.sum(F.pow(F.col("b") - F.col("n") * F.col("p"), 2) - F.col("n") * q).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * q).alias("pairs"),
    ).head()
    rho = min(0.5, max(1e-4, (r["over"] or 0.0) / r["pairs"])) if r["pairs"] else 0.5
    return round(1 / rho - 1, 6)


def host_reputation(hosts: DataFrame) -> DataFrame:
    """Posterior of every host from ``hosts(host, rows, n, b)``: n labelled pages, b of them bad.

    Returns host, rows, n, b, rate, lower. The priors run from all pages to suffix, to
    registered domain, to host. Without a label anywhere the rate is 1/2 at every level.
    """
    full = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    top = full.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).head()
    p0 = ((top["b"] or 0) + 1) / ((top["n"] or 0) + 2)
    parents, on = None, None
    for level in ("suffix", "domain", "host"):
        keys = {"suffix": ["suffix"], "domain": ["domain", "suffix"], "host": ["host", "domain", "rows"]}[level]
        own = full.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        own = own.withColumn("p", F.lit(p0)) if parents is None else own.join(parents, on)
        own = staged(own, f"reputation-{level}")
        m = _strength(own)
        mean = (F.col("b") + m * F.col("p")) / (F.col("n") + m)
        rated = own.withColumn("rate", mean).withColumn("m", F.lit(m))
        parents, on = rated.select(level, F.col("rate").alias("p")), level
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("m") + 1))
    return rated.select("host", "rows", "n", "b", "rate", (F.col("rate") - Z * sd).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], block_rate: float = BLOCK_RATE) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, bad_rate, lower_bound``.

    ``pages`` (page_id, url), ``outcomes`` (page_ref bigint, bad 0/1): a page's label is
    that of the number which ends its path, the worst if there are several. A rule decides
    where one fits, the longest of them; else the host's posterior bound. Null or malformed
    urls have an empty host and path and are judged by the rate of the empty host. Repeated
    rows are judged alike; an empty table gives an empty result.
    """
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    ref = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    parsed = staged(parsed.withColumn("page_ref", ref.try_cast("bigint")), "urls")
    known = outcomes.filter("page_ref is not null and bad is not null").groupBy("page_ref").agg(F.max("bad").alias("bad"))
    refs = parsed.filter("page_ref is not null").groupBy("host", "page_ref").agg(F.count(F.lit(1)).alias("k"))
    judged = refs.join(known, "page_ref").groupBy("host").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("bad")).alias("b"))
    seen = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("rows"))
    hosts = staged(seen.join(judged, "host", "left").fillna(0, ["n", "b"]), "hosts")
    rated = staged(host_reputation(hosts).select("host", "rows", "rate", "lower"), "rated")
    fit = matched_rule(F.col("host"), F.col("path"), rules)
    return (
        skew_join(parsed, rated, ["host"], "rows")
        .withColumn("_fit", fit)
        .select(
            "page_id",
            "host",
            "path",
            F.col("_fit.rule").alias("rule"),
            F.coalesce(F.col("_fit.verdict"), F.when(F.col("lower") > block_rate, "block").otherwise("allow")).alias("verdict"),
            F.round("rate", 6).alias("bad_rate"),
            F.round("lower", 6).alias("lower_bound"),
        )
    )
