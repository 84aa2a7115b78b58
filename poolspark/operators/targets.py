"""Target slices of the master table and their affinity reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from poolspark.functions.features import DEFAULT_BITS, DEFAULT_RADIUS
from poolspark.functions.measures import activity_label
from poolspark.operators.ranking import HOT_ROWS, exact_percentiles
from poolspark.session import cut_lineage
from poolspark.sources.registry import MATCH_MODES

# Fixed values.
REPORT_PERCENTILES = (0, 10, 25, 50, 75, 90, 95, 99, 100)
REPORT_THRESHOLDS = (10, 50, 100, 500, 1000, 5000, 10000)
AFFINITY_BINS = 60


def filter_target(df: DataFrame, query: str, match: str = "contains", name: str = "target_name") -> DataFrame:
    """Rows whose target name equals or literally contains the query, ignoring case."""
    if match not in MATCH_MODES:
        raise ValueError(f"unknown match mode {match!r}, known are {MATCH_MODES}")
    lowered = F.lower(F.col(name))
    wanted = F.lower(F.lit(query))
    return df.where(lowered == wanted if match == "exact" else F.contains(lowered, wanted))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no row for {what}")
    return df


# Characters of a gram of the name index. Shorter queries are looked up by grams of their own length.
GRAM = 3
# Rows of names and their targets that are sent to every executor; more are joined by a shuffle.
MAX_SENT_ROWS = 200_000


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; the empty run is in every text."""
    if size == 0:
        return F.array(F.lit(""))
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, F.lit(size))))


def _names_that_contain(names: DataFrame, queries: DataFrame, name: str) -> DataFrame:
    """(name, query_lc) of distinct ``queries`` (query_lc) that a distinct name holds literally.

    Names are listed under their grams; a query is looked up by the one of its grams that the fewest names hold, then verified.
    """
    found = None
    sizes = queries.select(F.least(F.lit(GRAM), F.length("query_lc")).alias("n")).distinct().collect()  # at most 0 to GRAM
    for size in sorted(r.n for r in sizes):
        index = names.select(name, F.explode(_grams(F.col(name), size)).alias("gram"))
        held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        own = queries.where(F.least(F.lit(GRAM), F.length("query_lc")) == size)
        own = own.select("query_lc", F.explode(_grams(F.col("query_lc"), size)).alias("gram"))
        rarity = F.struct(F.coalesce("n", F.lit(0)), "gram")
        rarest = own.join(held, "gram", "left").groupBy("query_lc").agg(F.min_by("gram", rarity).alias("gram"))
        part = index.join(rarest, "gram").where(F.contains(F.col(name), F.col("query_lc"))).select(name, "query_lc")
        found = part if found is None else found.unionByName(part)
    return names.select(name, F.lit("").alias("query_lc")).limit(0) if found is None else found


def match_names(names: DataFrame, registry: DataFrame, name: str = "target_lc") -> DataFrame:
    """Which registry target each distinct lower-case name belongs to (possibly several).

    Exact queries are an equi join; "contains" queries are looked up in a gram index of the distinct names. Names are never
    compared with all queries.
    """
    wanted = registry.withColumn("query_lc", F.lower("query"))
    contained = wanted.where(F.col("match") == "contains")
    pairs = _names_that_contain(names, contained.select("query_lc").where("query_lc IS NOT NULL").distinct(), name)
    columns = [name, "target", "query", "match", "threshold"]
    exact = names.join(wanted.where(F.col("match") == "exact"), F.col(name) == F.col("query_lc")).select(*columns)
    return exact.unionByName(pairs.join(contained, "query_lc").select(*columns))


def label_targets(master: DataFrame, registry: DataFrame) -> DataFrame:
    """Slices of all registry targets at once, labelled at each target's own threshold.

    The master's default label is kept as label_default. The names and their targets are counted first: up to MAX_SENT_ROWS
    go to the master's rows, however many rows a name has.
    """
    names = cut_lineage(master.select("target_lc").distinct())
    mapping = cut_lineage(match_names(names, registry))
    if mapping.count() <= MAX_SENT_ROWS:
        mapping = F.broadcast(mapping)
    return (
        master.withColumnRenamed("label", "label_default")
        .join(mapping, "target_lc")
        .withColumn("label", activity_label(F.col("value_median"), F.col("threshold")))
        .drop("target_lc")
    )


def missing_targets(sliced: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry targets without a single row."""
    return registry.join(sliced.select("target").distinct(), "target", "left_anti")


def affinity_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int] = REPORT_PERCENTILES, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """keys, percent, value: exact percentiles in long form."""
    wide = exact_percentiles(df, keys, value, [p / 100 for p in percents], hot_rows)
    names = F.array(*[F.lit(int(p)) for p in percents])
    pairs = F.explode(F.arrays_zip(names.alias("percent"), F.col("percentiles").alias("value"))).alias("p")
    return wide.select(*keys, pairs).select(*keys, F.col("p.percent").alias("percent"), F.col("p.value").alias("value"))


def threshold_sweep(
    df: DataFrame, keys: Sequence[str], value: str, thresholds: Sequence[int] = REPORT_THRESHOLDS
) -> DataFrame:
    """keys, threshold, active_fraction. One aggregate per threshold in one pass, then unpivoted."""
    wide = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        *[F.avg((F.col(value) <= t).cast("int")).alias(str(t)) for t in thresholds]
    )
    long = wide.unpivot(list(keys), [str(t) for t in thresholds], "threshold", "active_fraction")
    return long.withColumn("threshold", F.col("threshold").cast("int"))


def type_share(df: DataFrame, keys: Sequence[str], kind: str = "measure_type") -> DataFrame:
    """Share of each type within its group in percent, two decimals; missing types excluded."""
    counts = df.where(F.col(kind).isNotNull()).groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys))
    return counts.withColumn("share", F.round(F.lit(100.0) * F.col("n") / total, 2))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Equal-width counts between each group's min and max: keys, bin, left, right, n.

    Only occupied bins are listed; the maximum belongs to the last bin, as in a plot. A group
    with one single value spans [value - 0.5, value + 0.5].
    """
    counted = df.na.drop(subset=[*keys, value]).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    bounds = counted.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    same = F.col("_lo") == F.col("_hi")
    bounds = bounds.select(
        *keys,
        F.when(same, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
        F.when(same, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    position = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1
    binned = counted.join(bounds, list(keys)).withColumn("bin", F.least(position, F.lit(bins)).cast("int"))
    return (
        binned.groupBy(*keys, "bin", "lo", "hi")
        .agg(F.sum("_n").alias("n"))
        .select(*keys, "bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("left_edge"),
                (F.col("lo") + width * F.col("bin")).alias("right_edge"), "n")
    )


def log_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = AFFINITY_BINS) -> DataFrame:
    """Histogram of log10 of a positive measure."""
    logged = df.where(F.col(value) > 0).withColumn("_log", F.log10(value))
    return histogram(logged, keys, "_log", bins)


def target_metadata(sliced: DataFrame, valid: str | None = None) -> DataFrame:
    """Per target: raw and valid rows, active fraction and the settings they were made with.

    ``valid`` names the feature column whose NULL marks an item that could not be featurised.
    n_repeated counts entities that occur under several measure types; a split by row can put
    these on both sides.
    """
    kept = F.lit(True) if valid is None else F.col(valid).isNotNull()
    per_entity = sliced.groupBy("target", "query", "match", "threshold", "entity_key").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(F.when(kept, 1)).alias("_valid"),
        F.sum(F.when(kept, F.col("label"))).alias("_active"),
    )
    return per_entity.groupBy("target", "query", "match", "threshold").agg(
        F.sum("_rows").alias("n_raw"),
        F.sum("_valid").alias("n_valid"),
        (F.sum("_active") / F.nullif(F.sum("_valid"), F.lit(0))).alias("active_fraction"),
        F.count(F.when(F.col("_rows") > 1, 1)).alias("n_repeated"),
    )


def metadata_documents(
    metadata: DataFrame, base_dir: str, radius: int = DEFAULT_RADIUS, n_bits: int = DEFAULT_BITS
) -> DataFrame:
    """The nested per-target document that is written next to the prepared tables."""
    return metadata.select(
        "target",
        "query",
        F.col("n_raw").alias("n_molecules_raw"),
        F.col("n_valid").alias("n_molecules_valid"),
        "active_fraction",
        F.struct(
            F.lit("hashed n-grams").alias("type"),
            F.lit(radius).alias("radius"),
            F.lit(n_bits).alias("n_bits"),
        ).alias("fingerprint"),
        F.col("threshold").alias("activity_threshold_nM"),
        "match",
        F.lit("string_profile").alias("descriptor_set"),
        F.current_timestamp().cast("string").alias("created_at"),
        F.struct(
            F.concat(F.lit(f"{base_dir}/prepared/target="), "target").alias("prepared"),
            F.concat(F.lit(f"{base_dir}/descriptors/target="), "target").alias("descriptors"),
        ).alias("files"),
    )
