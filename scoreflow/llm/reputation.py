"""URL filter: explicit rules, then the reputation of the host by empirical Bayes.

Outcomes of labelled pages (1 good, 0 bad) are counted per host, registered domain and suffix.
At each level a beta-binomial prior is fitted by moments over the groups of the level; its mean
is the posterior mean of the level above (suffix above domain above host, all pages above suffix).
A page passes if the lower posterior bound of its host's share of good pages reaches a threshold.

Everything is plain DataFrame code: two small aggregates per level and joins on the host.
Null and odd urls have host '' and path '' and share one reputation. Hosts without outcomes take
the prior of their domain. With no outcomes at all the prior is Beta(1, 1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.llm.common import LOWER
from scoreflow.operators.frame import salted_join

# Suffixes of two labels under which names are registered, unless others are given.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "com.br", "co.in",
                      "co.nz", "co.za")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEVELS = ("suffix", "domain", "host")
LEAST_RHO, MOST_RHO = 1e-4, 0.5


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/ ? #``, A-Z lower-cased; '' for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), *LOWER), F.lit(""))


def suffix_patterns(suffixes: Sequence[str]) -> tuple[str, str]:
    """Patterns of a host's suffix and of its registered domain."""
    two = "".join(s.replace(".", r"\.") + "|" for s in suffixes)
    return rf"(?:^|\.)({two}[^.]*)$", rf"(?:^|\.)([^.]*\.(?:{two}[^.]*)|[^.]*)$"


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; '' for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits, as text and as verdict; null if none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _prior(groups: DataFrame) -> DataFrame:
    """One row: mean ``m`` and strength ``s`` of the beta prior over the groups' (n, k)."""
    n, k = F.col("n"), F.col("k")
    sums = groups.where(n > 0).agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("double").alias("sn"),
        F.coalesce(F.sum(k), F.lit(0)).cast("double").alias("sk"),
        F.coalesce(F.sum(n * n), F.lit(0)).cast("double").alias("snn"),
        F.coalesce(F.sum(k * k / n), F.lit(0.0)).alias("skkn"),
        F.count(F.lit(1)).cast("double").alias("g"))
    mean = F.when(F.col("sn") > 0, F.col("sk") / F.col("sn")).otherwise(0.5)
    sums = sums.withColumn("m", mean).withColumn("v", F.col("m") * (1 - F.col("m")))
    spread = F.col("skkn") - F.col("m") * F.col("sk")
    freedom = F.col("v") * (F.col("sn") - F.col("snn") / F.col("sn") - (F.col("g") - 1))
    rho = F.when((F.col("sn") > 0) & (F.col("g") > 1) & (freedom > 0),
                 (spread - (F.col("g") - 1) * F.col("v")) / freedom).otherwise(1 / 3)
    rho = F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), rho))
    return sums.select("m", (1 / rho - 1).alias("s"))


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645,
                    suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Columns ``host, n, mean, bound`` for every distinct host of both frames.

    ``hosts`` has ``host``; ``outcomes`` has ``host, good`` with good 0, 1 or null (not counted).
    ``suffixes`` are those of several labels under which names are registered; any other suffix is
    the last label.
    """
    of_suffix, of_domain = suffix_patterns(suffixes)
    counts = (hosts.select("host", F.lit(0).alias("n"), F.lit(0).alias("k"))
              .unionAll(outcomes.where(F.col("good").isNotNull())
                        .select("host", F.lit(1).alias("n"), F.col("good").cast("int").alias("k")))
              .groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
              .select("host", F.regexp_extract("host", of_domain, 1).alias("domain"),
                      F.regexp_extract("host", of_suffix, 1).alias("suffix"), "n", "k"))
    top = _prior(counts).select(F.col("m").alias("above"))
    known = None
    for level in LEVELS:
        keys = LEVELS[:LEVELS.index(level) + 1]
        groups = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        strength = _prior(groups).select("s")
        if known is None:
            groups = groups.crossJoin(F.broadcast(top))  # one row
        else:
            groups = groups.join(known, list(keys[:-1]))
        groups = groups.crossJoin(F.broadcast(strength))  # one row
        mean = (F.col("k") + F.col("s") * F.col("above")) / (F.col("n") + F.col("s"))
        known = groups.select(*keys, "n", "s", mean.alias("mean"))
        if level != "host":
            known = known.select(*keys, F.col("mean").alias("above"))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("s") + 1))
    return known.select("host", "n", "mean", (F.col("mean") - z * spread).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]],
                least: float = 0.5, z: float = 1.645, key: str = "page_id",
                url: str = "url", suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, and the bound of its host.

    ``outcomes`` has ``url, good``. Rules come first, the reputation decides the rest. Repeated rows
    are judged one by one. One host may hold most pages: its rows are spread over tasks by a salt.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    seen = outcomes.select(host_of(F.col("url")).alias("host"), "good")
    known = host_reputation(rows.select("host").distinct(), seen, z, suffixes).select("host", "bound")
    judged = F.when(F.col("bound") >= least, F.lit("allow")).otherwise(F.lit("block"))
    return salted_join(rows, known, ["host"], F.struct("page_id", "path")).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, judged).alias("verdict"),
        F.round("bound", 6).alias("bound"))
