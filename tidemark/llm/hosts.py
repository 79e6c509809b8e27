"""URL filters: allow / block rules first, then empirical-Bayes host reputation.

A page that a rule decides is a labelled outcome (block: bad).  Outcomes are counted per host, registered
domain and suffix.  Each level's bad rate gets a beta prior whose mean is the posterior mean of the level
above and whose strength is estimated from how far its units' rates scatter (method of moments on the
beta-binomial); the suffix level shrinks to the rate of all labelled pages.  An undecided page is blocked
when the lower bound of its host's posterior (mean - z * standard deviation) is over ``threshold``; a host
without outcomes carries its domain's prior, one of an unseen suffix the overall rate.

Counting is a partial aggregate per host, so a host with a third of all pages is no hot task.

Edge cases: null url or one without ``://`` has empty host and path, is fitted by no rule and carries the
overall rate; no labelled page at all gives rate 0 and verdict allow; repeated pages are judged alike; an
empty table gives no rows; rules that tie in length are taken by longer host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, lookup_join, packed_row, table

#: (verdict, host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
THRESHOLD = 0.5
Z = 1.645
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or no ``://``."""
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, _URL, 1), _UPPER, _LOWER), F.regexp_extract(u, _URL, 2)


def rule_match(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict); null if none.  ``rules`` is configuration, not data."""
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"), r[1])):  # the last that fits wins
        h, slash, p = rule.partition("/")
        here = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        fit = F.when(here, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def _domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _shrunk(units: DataFrame, unit: str, parent: str, priors: DataFrame) -> DataFrame:
    """(unit, mean, strength, n) of each unit's posterior: prior mean from its parent, strength by moments.

    For rates r_i = bad_i / n_i around prior means m_i, Var(r_i) = m_i (1 - m_i) (1 + (n_i - 1) rho) / n_i;
    rho is solved from the sums over all units, and strength = 1 / rho - 1.
    """
    x = units.join(priors.select(F.col("unit").alias("__parent"), F.col("mean").alias("__m")),
                   F.col(parent) == F.col("__parent"), "left").drop("__parent")
    v = F.col("__m") * (1.0 - F.col("__m"))
    fit = x.agg(F.sum(F.col("n") * (F.col("bad") / F.col("n") - F.col("__m")) * (F.col("bad") / F.col("n") - F.col("__m"))).alias("ss"),
                F.sum(v).alias("v0"), F.sum(v * (F.col("n") - 1)).alias("v1")).first()
    rho = (fit["ss"] - fit["v0"]) / fit["v1"] if fit["v1"] else 0.5
    strength = 1.0 / min(max(rho, 1e-4), 0.999) - 1.0
    total = F.col("n") + strength
    return x.select(F.col(unit).alias("unit"), ((F.col("__m") * strength + F.col("bad")) / total).alias("mean"),
                    total.alias("strength"))


def host_reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Posteriors of hosts, domains and suffixes from (host, bad), and the overall bad rate."""
    host = F.col("host")
    hosts = checkpoint(outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
                       .withColumn("domain", _domain(host)).withColumn("suffix", _suffix(host)))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("all", F.lit(""))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = float(total["bad"] / total["n"]) if total["n"] else 0.0
    root = hosts.sparkSession.range(1).select(F.lit("").alias("unit"), F.lit(overall).alias("mean"))
    by_suffix = checkpoint(_shrunk(suffixes, "suffix", "all", root))
    by_domain = checkpoint(_shrunk(domains, "domain", "suffix", by_suffix))
    by_host = checkpoint(_shrunk(hosts, "host", "domain", by_domain))
    return by_host, by_domain, by_suffix, overall


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and the reputation mean and bound used for undecided pages."""
    host, path = url_parts(F.col(url_col))
    x = (pages.select(packed_row(pages), host.alias("host"), path.alias("path"))
         .withColumn("__rule", rule_match(F.col("host"), F.col("path"), rules)))
    decided = x.where(F.col("__rule").isNotNull()).select("host", (F.col("__rule.verdict") == "block").alias("bad"))
    by_host, by_domain, by_suffix, overall = host_reputation(decided)
    x = x.withColumn("__domain", _domain(F.col("host"))).withColumn("__suffix", _suffix(F.col("host")))
    for level, key, rep in (("h", "host", by_host), ("d", "__domain", by_domain), ("s", "__suffix", by_suffix)):
        rep = rep.select(F.col("unit").alias(f"__{level}"), F.col("mean").alias(f"__{level}m"), F.col("strength").alias(f"__{level}k"))
        x = lookup_join(x, rep, F.col(key) == F.col(f"__{level}"))
    mean = F.coalesce("__hm", "__dm", "__sm", F.lit(overall))
    strength = F.coalesce("__hk", "__dk", "__sk", F.lit(1.0))
    bound = mean - z * F.sqrt(mean * (1.0 - mean) / (strength + 1.0))
    x = x.withColumn("__mean", mean).withColumn("__bound", bound)
    learned = F.when(F.col("__bound") > threshold, "block").otherwise("allow")
    return x.select("__row", "host", "path", F.col("__rule.rule").alias("rule"),
                    F.coalesce(F.col("__rule.verdict"), learned).alias("verdict"),
                    F.col("__mean").alias("bad_rate"), F.col("__bound").alias("bad_rate_bound"))


def op8_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page's url."""
    x = judge(table(spark, sf_dir, "pages"))
    return x.select("__row.page_id", "host", "path", "rule", "verdict",
                    (F.round(F.col("bad_rate_bound") * 1e4) / 1e4).alias("bad_rate_bound"))


ORACLE = r"""
WITH p0 AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
p1 AS (SELECT *, '.' || host AS dh FROM p0),
p AS (SELECT page_id, host, path, CASE
    WHEN dh LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN dh LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN dh LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN dh LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN dh LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule,
    split_part(host, '.', -1) AS suf,
    CASE WHEN contains(host, '.') THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS dom FROM p1),
h AS (SELECT host, dom, suf, count(*) AS n, sum(CASE WHEN rule IN ('org/', 'com/fr/') THEN 0 ELSE 1 END)::DOUBLE AS bad
  FROM p WHERE rule IS NOT NULL GROUP BY ALL),
o AS (SELECT coalesce(sum(bad) / sum(n), 0) AS r FROM h),
s AS (SELECT suf, sum(n) AS n, sum(bad) AS bad, any_value(r) AS m FROM h, o GROUP BY ALL),
sk AS (SELECT 1.0 / least(greatest(CASE WHEN sum(m*(1-m)*(n-1)) <> 0 THEN
   (sum(n*(bad/n-m)*(bad/n-m)) - sum(m*(1-m))) / sum(m*(1-m)*(n-1)) ELSE 0.5 END, 1e-4), 0.999) - 1 AS k FROM s),
sp AS (SELECT suf, (m*k + bad)/(n+k) AS mean, n+k AS st FROM s, sk),
d AS (SELECT dom, h.suf, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS m FROM h JOIN sp USING (suf) GROUP BY ALL),
dk AS (SELECT 1.0 / least(greatest(CASE WHEN sum(m*(1-m)*(n-1)) <> 0 THEN
   (sum(n*(bad/n-m)*(bad/n-m)) - sum(m*(1-m))) / sum(m*(1-m)*(n-1)) ELSE 0.5 END, 1e-4), 0.999) - 1 AS k FROM d),
dp AS (SELECT dom, (m*k + bad)/(n+k) AS mean, n+k AS st FROM d, dk),
h2 AS (SELECT host, n, bad, mean AS m FROM h JOIN dp USING (dom)),
hk AS (SELECT 1.0 / least(greatest(CASE WHEN sum(m*(1-m)*(n-1)) <> 0 THEN
   (sum(n*(bad/n-m)*(bad/n-m)) - sum(m*(1-m))) / sum(m*(1-m)*(n-1)) ELSE 0.5 END, 1e-4), 0.999) - 1 AS k FROM h2),
hp AS (SELECT host, (m*k + bad)/(n+k) AS mean, n+k AS st FROM h2, hk),
j AS (SELECT p.*, coalesce(hp.mean, dp.mean, sp.mean, r) AS mean, coalesce(hp.st, dp.st, sp.st, 1.0) AS st
  FROM p LEFT JOIN hp USING (host) LEFT JOIN dp USING (dom) LEFT JOIN sp USING (suf), o),
b AS (SELECT *, mean - 1.645 * sqrt(mean * (1 - mean) / (st + 1)) AS bound FROM j)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(bound * 10000) / 10000 AS bad_rate_bound FROM b
"""
