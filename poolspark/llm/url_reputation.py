"""URL filter by host reputation, shrunk from host to registered domain to suffix.

Pages with a known outcome (good or bad) are counted per host. The share of good pages of a suffix is
shrunk to the share of all pages, that of a registered domain to its suffix, that of a host to its
registered domain, each with a beta prior whose strength is estimated from the spread of the level
(beta-binomial moments). A host is blocked when the upper posterior bound of its good share is below
``min_good``. Rules by host and path come first; the longest fitting rule decides.

Cases: a null url or one without ``://`` has an empty host and path and is judged by the prior of all
pages; null outcomes do not count; without outcomes the prior is even and nothing is blocked; repeated
rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import join_narrow, shared_table

#: Suffixes of two labels under which domains are registered (fixed values; extend as needed).
WIDE_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def suffix_of(host: Column, wide: tuple[str, ...] = WIDE_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*wide) & host.contains("."), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, wide: tuple[str, ...] = WIDE_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*wide), F.substring_index(host, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame, mean: float) -> float:
    """Prior observations of a level: (1 - r) / r for the moment estimate r of the correlation within its groups."""
    k, n, squares, spread = level.where("n > 0").agg(
        F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.sum(F.col("n").cast("double") * F.col("n")),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.lit(mean), 2))).first()
    noise = mean * (1 - mean)
    if k < 2 or noise <= 0:
        return 10.0
    room = n - squares / n - (k - 1)
    r = (spread / noise - (k - 1)) / room if room > 0 else 0.1
    r = min(0.99, max(0.001, r))
    return (1 - r) / r


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, good, share, low, high) for every host of ``outcomes`` (host, good 0/1 or null).

    Levels are one row per host, domain and suffix; only sums of each level reach the driver.
    """
    hosts = shared_table(outcomes.groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good")), "hosts")
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    sums = lambda by: shared_table(hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("good").alias("good")), by[0])
    domains, suffixes = sums(["domain", "suffix"]), sums(["suffix"])
    n, good = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    mean = (good + 1) / (n + 2)
    shrink = lambda prior, c: (F.col("good") + F.lit(c) * prior) / (F.col("n") + F.lit(c))
    c_host, c_domain, c_suffix = (_strength(x, mean) for x in (hosts, domains, suffixes))
    suffixes = suffixes.select("suffix", shrink(F.lit(mean), c_suffix).alias("_suffix"))
    domains = join_narrow(domains, shared_table(suffixes, "suffix-share"), ["suffix"], F.col("domain"))
    domains = domains.select("domain", shrink(F.col("_suffix"), c_domain).alias("_domain"))
    hosts = join_narrow(hosts, shared_table(domains, "domain-share"), ["domain"], F.col("host"))
    share = shrink(F.col("_domain"), c_host)
    sd = F.sqrt(share * (1 - share) / (F.col("n") + F.lit(c_host + 1)))
    return hosts.select("host", "n", "good", share.alias("share"), F.greatest(F.lit(0.0), share - z * sd).alias("low"),
                        F.least(F.lit(1.0), share + z * sd).alias("high"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], min_good: float = 0.6) -> DataFrame:
    """(page_id, host, path, rule, verdict, share, high) for every row of ``pages`` (page_id, url).

    ``outcomes`` has (page_id, good); a page with several outcomes counts by their smallest.
    """
    host, path = host_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.groupBy("page_id").agg(F.min("good").alias("good")).where("page_id is not null")
    seen = parts.select("page_id", "host").join(known, "page_id", "left").select("host", "good")
    table = shared_table(reputation(seen).select("host", "share", "high"), "reputation")
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(ruled, F.when(F.col("high") < F.lit(min_good), F.lit("block")).otherwise(F.lit("allow")))
    return join_narrow(parts, table, ["host"], F.col("page_id"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "share", "high")
