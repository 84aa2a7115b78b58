"""Registered queries: summaries, comparison tables and descriptor reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolspark.catalog import standins as st
from poolspark.functions.features import DESCRIPTORS
from poolspark.operators import features, report, targets
from poolspark.operators.pool import STRATEGIES
from poolspark.plans.compare import compare_targets, panel_rows, target_cards
from poolspark.sources.tables import spread

QUERIES = {}
SQL = {}

METRICS = ("roc_auc_mean", "roc_auc_std", "actives_mean", "actives_std")
AGG_SQL = """avg(roc_auc) AS roc_auc_mean, stddev_samp(roc_auc) AS roc_auc_std,
  avg(n_actives_found) AS actives_mean, stddev_samp(n_actives_found) AS actives_std"""
SUMMARY_SQL = f"""{st.HISTORY_SQL},
summary AS (SELECT target, initialization_strategy, strategy, round, {AGG_SQL} FROM history GROUP BY 1, 2, 3, 4)"""
BY_TARGET_SQL = f"""{st.HISTORY_SQL},
summary AS (SELECT target, initialization_strategy, strategy, round, {AGG_SQL} FROM history GROUP BY 1, 2, 3, 4),
best AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY target, strategy
  ORDER BY roc_auc_mean DESC, initialization_strategy) AS r FROM summary WHERE round = 10) WHERE r = 1),
cells AS (SELECT t.target, s.position, s.strategy, b.roc_auc_mean AS value
  FROM (SELECT DISTINCT target FROM best) t
  CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS position,
    unnest(['greedy', 'random', 'uncertainty_topk', 'uncertainty_diverse', 'query_by_committee']) AS strategy) s
  LEFT JOIN best b USING (target, strategy))"""
LABEL_SQL = """CASE strategy WHEN 'greedy' THEN 'Greedy' WHEN 'random' THEN 'Random' WHEN 'uncertainty_topk' THEN 'Top-K'
  WHEN 'uncertainty_diverse' THEN 'Diverse' WHEN 'query_by_committee' THEN 'QBC' END"""


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rounded_sql(columns=METRICS, digits=6) -> str:
    return "* REPLACE (" + ", ".join(f"round({c}, {digits}) AS {c}" for c in columns) + ")"


def summary(spark, sf_dir):
    return report.summarize(st.history(spark, sf_dir))


def best(spark, sf_dir):
    return report.best_initialization(summary(spark, sf_dir))


# Means of up to 64 values of two decimals end exactly at a half of the sixth decimal; nine hold them whole.
QUERIES["summary"] = lambda spark, sf_dir: rounded(summary(spark, sf_dir), *METRICS, digits=9)
SQL["summary"] = f"WITH {SUMMARY_SQL} SELECT {rounded_sql(digits=9)} FROM summary"

QUERIES["auc_band"] = lambda spark, sf_dir: rounded(
    report.auc_band(summary(spark, sf_dir)).select(*report.CAMPAIGN_KEYS, "roc_auc_mean", "auc_low", "auc_high"),
    "roc_auc_mean", "auc_low", "auc_high", digits=9,
)
SQL["auc_band"] = f"""WITH {SUMMARY_SQL}
SELECT target, initialization_strategy, strategy, round, round(roc_auc_mean, 9) AS roc_auc_mean,
  round(roc_auc_mean - roc_auc_std, 9) AS auc_low, round(roc_auc_mean + roc_auc_std, 9) AS auc_high FROM summary"""

QUERIES["round_filter"] = lambda spark, sf_dir: rounded(report.at_round(summary(spark, sf_dir)), *METRICS).orderBy(
    "target", "initialization_strategy", "strategy"
)
SQL["round_filter"] = f"WITH {SUMMARY_SQL} SELECT {rounded_sql()} FROM summary WHERE round = 10 ORDER BY 1, 2, 3"

QUERIES["best_init"] = lambda spark, sf_dir: rounded(best(spark, sf_dir), *METRICS)
SQL["best_init"] = f"WITH {BY_TARGET_SQL} SELECT {rounded_sql()} FROM best"

QUERIES["best_overall"] = lambda spark, sf_dir: rounded(report.best_campaign(summary(spark, sf_dir)), *METRICS)
SQL["best_overall"] = f"""WITH {SUMMARY_SQL}
SELECT {rounded_sql()} FROM (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY target
  ORDER BY roc_auc_mean DESC, initialization_strategy, strategy) AS r FROM summary WHERE round = 10) WHERE r = 1)"""

QUERIES["metric_matrix"] = lambda spark, sf_dir: rounded(report.metric_matrix(best(spark, sf_dir), "roc_auc_mean"), *STRATEGIES)
SQL["metric_matrix"] = f"""WITH {BY_TARGET_SQL}
SELECT target, {", ".join(f"round(max(CASE WHEN strategy = '{s}' THEN roc_auc_mean END), 6) AS {s}" for s in STRATEGIES)}
FROM best GROUP BY target"""

QUERIES["rank_table"] = lambda spark, sf_dir: report.rank_table(best(spark, sf_dir))
SQL["rank_table"] = f"""WITH {BY_TARGET_SQL},
r AS (SELECT target, {LABEL_SQL} AS label, row_number() OVER (PARTITION BY target ORDER BY value DESC NULLS LAST, position) AS r FROM cells)
SELECT target, {", ".join(f"max(CASE WHEN r = {i} THEN label END) AS rank_{i}" for i in range(1, 6))} FROM r GROUP BY target"""

QUERIES["win_counts"] = lambda spark, sf_dir: report.win_counts(best(spark, sf_dir))
SQL["win_counts"] = f"""WITH {BY_TARGET_SQL},
w AS (SELECT strategy FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY value DESC, position) AS r
  FROM cells WHERE value IS NOT NULL) WHERE r = 1)
SELECT s.strategy, {LABEL_SQL.replace('CASE strategy', 'CASE s.strategy')} AS label, count(w.strategy) AS wins
FROM (SELECT DISTINCT strategy FROM cells) s LEFT JOIN w ON s.strategy = w.strategy GROUP BY s.strategy"""

QUERIES["heatmap_norm"] = lambda spark, sf_dir: rounded(report.heatmap_cells(best(spark, sf_dir), "roc_auc_mean"), "value", "scaled")
SQL["heatmap_norm"] = f"""WITH {BY_TARGET_SQL}
SELECT target, strategy, round(value, 6) AS value,
  round((value - (SELECT min(value) FROM cells)) / ((SELECT max(value) FROM cells) - (SELECT min(value) FROM cells) + CAST(1e-12 AS DOUBLE)), 6) AS scaled
FROM cells"""

QUERIES["pareto"] = lambda spark, sf_dir: rounded(report.pareto_points(best(spark, sf_dir)), "roc_auc_mean", "actives_mean")
SQL["pareto"] = f"""WITH {BY_TARGET_SQL}
SELECT target, strategy, {LABEL_SQL} AS label, round(roc_auc_mean, 6) AS roc_auc_mean, round(actives_mean, 6) AS actives_mean FROM best"""


def metric_join(spark, sf_dir):
    runs = st.history(spark, sf_dir).select("target", "initialization_strategy", "strategy", "seed", "round")
    joined = report.attach_metric(runs, summary(spark, sf_dir))
    return rounded(joined, "roc_auc_mean", "roc_auc_std", "actives_mean")


QUERIES["metric_join"] = metric_join
SQL["metric_join"] = f"""WITH {SUMMARY_SQL}
SELECT h.target, h.initialization_strategy, h.strategy, h.seed, h.round, round(s.roc_auc_mean, 6) AS roc_auc_mean,
  round(s.roc_auc_std, 6) AS roc_auc_std, round(s.actives_mean, 6) AS actives_mean,
  {LABEL_SQL.replace('CASE strategy', 'CASE h.strategy')} AS label
FROM history h JOIN summary s ON h.target = s.target AND h.initialization_strategy = s.initialization_strategy AND h.strategy = s.strategy AND s.round = 10"""

# Descriptors: documents profiled as strings, target = language ---------------------------------


def count_sql(chars: str) -> str:
    return f"length(text) - length(translate(text, '{chars}', ''))"


PROFILE_SQL = f"""
docs AS (
  SELECT doc_id AS mol_id, lang AS target, length(text) AS length,
    length(regexp_replace(regexp_replace(text, '[^ \\t\\r\\n]+', 'w', 'g'), '[ \\t\\r\\n]+', '', 'g')) AS n_words,
    {count_sql('0123456789')} AS n_digits, {count_sql('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} AS n_upper,
    {count_sql('.,;:!?()')} AS n_punct, {count_sql('aeiouAEIOU')} AS n_vowel, {count_sql(' ')} AS n_space
  FROM documents
),
profiles AS (
  SELECT d.target, d.mol_id, CAST(length AS INTEGER) AS length, CAST(n_words AS INTEGER) AS n_words,
    CAST(n_digits AS INTEGER) AS n_digits, CAST(n_upper AS INTEGER) AS n_upper, CAST(n_punct AS INTEGER) AS n_punct,
    n_vowel / CAST(nullif(length, 0) AS DOUBLE) AS vowel_ratio,
    (length - n_space) / CAST(nullif(n_words, 0) AS DOUBLE) AS mean_word,
    n_space / CAST(nullif(length, 0) AS DOUBLE) AS space_ratio, l.quality AS label
  FROM docs d LEFT JOIN labels l ON d.mol_id = l.doc_id
)"""
RATIOS = ("vowel_ratio", "mean_word", "space_ratio")


def descriptors(spark, sf_dir):
    docs = spread(
        st.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("mol_id"), F.col("lang").alias("target"), "text")
    )
    labels = st.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("mol_id"), F.col("quality").alias("label"))
    profiled = features.add_profile(docs, "text").select("target", "mol_id", *DESCRIPTORS)
    return profiled.join(labels, "mol_id", "left").select("target", "mol_id", *DESCRIPTORS, "label")


QUERIES["profile"] = lambda spark, sf_dir: rounded(descriptors(spark, sf_dir), *RATIOS)
SQL["profile"] = f"WITH {PROFILE_SQL} SELECT {rounded_sql(RATIOS)} FROM profiles"

QUERIES["descriptor_corr"] = lambda spark, sf_dir: rounded(report.descriptor_correlation(descriptors(spark, sf_dir), DESCRIPTORS), "r")
SQL["descriptor_corr"] = f"WITH {PROFILE_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({b}, {a}), 6) AS r FROM profiles" for a in DESCRIPTORS for b in DESCRIPTORS
)

QUERIES["descriptor_quantiles"] = lambda spark, sf_dir: rounded(
    report.descriptor_quantiles(descriptors(spark, sf_dir), DESCRIPTORS), "q01", "q25", "q50", "q75", "q99"
)
SQL["descriptor_quantiles"] = f"WITH {PROFILE_SQL} " + " UNION ALL ".join(
    f"SELECT target, '{d}' AS descriptor, "
    + ", ".join(f"round(quantile_cont(CAST({d} AS DOUBLE), {p}), 6) AS q{round(p * 100):02d}" for p in (0.01, 0.25, 0.5, 0.75, 0.99))
    + " FROM profiles GROUP BY target"
    for d in DESCRIPTORS
)

QUERIES["clip_limits"] = lambda spark, sf_dir: rounded(report.clip_limits(descriptors(spark, sf_dir), DESCRIPTORS), "low", "high")
SQL["clip_limits"] = f"WITH {PROFILE_SQL} " + " UNION ALL ".join(
    f"SELECT '{d}' AS descriptor, round(greatest(0.0, quantile_cont(CAST({d} AS DOUBLE), 0.01)), 6) AS low, "
    f"round(quantile_cont(CAST({d} AS DOUBLE), 0.99), 6) AS high FROM profiles"
    for d in DESCRIPTORS
)

QUERIES["descriptor_scatter"] = lambda spark, sf_dir: report.descriptor_scatter(descriptors(spark, sf_dir), "n_words", "n_digits")
SQL["descriptor_scatter"] = f"""WITH {PROFILE_SQL}
SELECT target, mol_id, CAST(n_words AS DOUBLE) AS x, CAST(n_digits AS DOUBLE) AS y, label,
  n_words <= (SELECT quantile_cont(CAST(n_words AS DOUBLE), 0.99) FROM profiles)
  AND n_digits <= (SELECT quantile_cont(CAST(n_digits AS DOUBLE), 0.99) FROM profiles) AS inside FROM profiles"""

QUERIES["dataset_table"] = lambda spark, sf_dir: report.dataset_table(targets.target_metadata(st.labelled(spark, sf_dir)))
SQL["dataset_table"] = f"""WITH {st.LABELLED_SQL}
SELECT target, count(*) AS molecules, round(avg(label), 3) AS active_fraction, threshold FROM labelled GROUP BY target, threshold"""

# Comparison of ten targets ----------------------------------------------------------------------

CARD_COLUMNS = DESCRIPTORS


def comparison_report(spark, sf_dir):
    """The cards of ten targets."""
    cards = target_cards(comparison(spark, sf_dir), CARD_COLUMNS)
    return rounded(cards, "best_auc", *[f"median_{c}" for c in CARD_COLUMNS])


def comparison(spark, sf_dir):
    """History, metadata and descriptors of the same ten targets (id modulo ten) put side by side."""
    ten = lambda number: F.concat(F.lit("T"), (number % 10).cast("string"))
    profiles = descriptors(spark, sf_dir).withColumn("target", ten(F.col("mol_id")))
    rows = st.master(spark, sf_dir).withColumn("target", ten(F.col("entity_key").cast("bigint")))
    metadata = targets.target_metadata(
        rows.withColumns({"query": F.col("target"), "match": F.lit("exact"), "threshold": F.lit(1000.0)})
    )
    return compare_targets(summary(spark, sf_dir), metadata, profiles, CARD_COLUMNS)


QUERIES["comparison_report"] = comparison_report
SQL["comparison_report"] = f"""WITH {BY_TARGET_SQL}, {PROFILE_SQL}, {st.MASTER_SQL},
meta AS (SELECT 'T' || CAST(CAST(entity_key AS BIGINT) % 10 AS VARCHAR) AS target, count(*) AS molecules,
  round(avg(label), 3) AS active_fraction FROM master GROUP BY 1),
r AS (SELECT target, {LABEL_SQL} AS label, row_number() OVER (PARTITION BY target ORDER BY value DESC NULLS LAST, position) AS r FROM cells),
ranks AS (SELECT target, {", ".join(f"max(CASE WHEN r = {i} THEN label END) AS rank_{i}" for i in range(1, 6))} FROM r GROUP BY target),
top AS (SELECT target, round(max(roc_auc_mean), 6) AS best_auc FROM best GROUP BY target),
med AS (SELECT 'T' || CAST(mol_id % 10 AS VARCHAR) AS target,
  {", ".join(f"round(median(CAST({c} AS DOUBLE)), 6) AS median_{c}" for c in CARD_COLUMNS)} FROM profiles GROUP BY 1)
SELECT target, molecules, active_fraction, CAST(1000.0 AS DOUBLE) AS threshold, ranks.* EXCLUDE (target), best_auc, med.* EXCLUDE (target)
FROM meta JOIN ranks USING (target) JOIN top USING (target) JOIN med USING (target)"""

QUERIES["comparison_panels"] = lambda spark, sf_dir: rounded(panel_rows(comparison(spark, sf_dir)), "x", "y")
PANEL_PARTS = (
    ("auc_heatmap", "target", "strategy", "value", "scaled", SQL["heatmap_norm"]),
    ("actives_heatmap", "target", "strategy", "value", "scaled", SQL["heatmap_norm"].replace("b.roc_auc_mean AS value", "b.actives_mean AS value")),
    ("wins", "NULL", "strategy", "wins", "NULL", SQL["win_counts"]),
    ("pareto", "target", "strategy", "roc_auc_mean", "actives_mean", SQL["pareto"]),
    ("limits", "NULL", "descriptor", "low", "high", SQL["clip_limits"]),
    ("correlation", "NULL", "a || ' ' || b", "r", "NULL", SQL["descriptor_corr"]),
)
SQL["comparison_panels"] = " UNION ALL ".join(
    f"SELECT '{panel}' AS panel, CAST({target} AS VARCHAR) AS target, {item} AS item, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM ({rows})"
    for panel, target, item, x, y, rows in PANEL_PARTS
)
