"""Registered queries: campaign grid, split, starting sets, pool state and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolspark.catalog import standins as st
from poolspark.functions.scoring import logistic_score
from poolspark.operators import committee, pool, select, targets
from poolspark.session import shared_table
from poolspark.operators.ranking import top_k

QUERIES = {}
SQL = {}
KEYS = ["seed", "target"]

QUERIES["campaign_grid"] = lambda spark, sf_dir: pool.campaign_grid(
    st.pool(spark, sf_dir), pool.INITIALIZATIONS, pool.STRATEGIES, st.SEEDS
)
SQL["campaign_grid"] = f"""WITH {st.POOL_SQL}, {st.SEEDS_SQL}
SELECT target || '/' || init || '/' || strategy || '/' || CAST(seed AS VARCHAR) AS campaign, target, init, strategy, seed
FROM (SELECT DISTINCT target FROM pool) CROSS JOIN (SELECT unnest(['random', 'diverse']) AS init)
CROSS JOIN (SELECT unnest(['greedy', 'random', 'uncertainty_topk', 'uncertainty_diverse', 'query_by_committee']) AS strategy)
CROSS JOIN seeds"""

SPLIT_SQL = f"""{st.POOL_SQL}, {st.SEEDS_SQL},
keyed AS (SELECT seed, target, mol_id, label, {st.draw_sql('seed')} AS k FROM pool CROSS JOIN seeds),
counts AS (SELECT target, seed, label, count(*) AS n FROM keyed GROUP BY ALL),
shares AS (SELECT *, n * total / size AS share FROM (
  SELECT *, sum(n) OVER (PARTITION BY target, seed) AS size,
    ceil(CAST(sum(n) OVER (PARTITION BY target, seed) AS DOUBLE) * CAST(0.2 AS DOUBLE)) AS total FROM counts)),
quota AS (SELECT *, floor(share) + CAST(
    row_number() OVER (PARTITION BY target, seed ORDER BY share - floor(share) DESC, label)
    <= total - sum(floor(share)) OVER (PARTITION BY target, seed) AS INTEGER) AS take FROM shares),
split AS (SELECT seed, target, mol_id, label,
    CASE WHEN row_number() OVER (PARTITION BY target, seed, label ORDER BY k, mol_id) <= take THEN 'test' ELSE 'pool' END AS split
  FROM keyed JOIN quota USING (target, seed, label))"""


def strat_split(spark, sf_dir):
    rows = st.with_seeds(st.pool(spark, sf_dir).select("target", "mol_id", "label"))
    return pool.stratified_split(rows, ["target"], method="md5").select("seed", "target", "mol_id", "label", "split")


QUERIES["strat_split"] = strat_split
SQL["strat_split"] = f"WITH {SPLIT_SQL} SELECT seed, target, mol_id, label, split FROM split"


def prepared_pool(spark, sf_dir):
    prepared = pool.prepare_pool(st.pool(spark, sf_dir), st.SEEDS, method="md5")
    return prepared.select("target", "mol_id", F.array_join(F.transform("test_mask", lambda m: m.cast("string")), ",").alias("test_mask"))


QUERIES["pool_flags"] = prepared_pool
SQL["pool_flags"] = f"""WITH {SPLIT_SQL}
SELECT target, mol_id, string_agg(CASE WHEN split = 'test' THEN 'true' ELSE 'false' END, ',' ORDER BY seed) AS test_mask
FROM split GROUP BY target, mol_id"""


def init_random(spark, sf_dir):
    prepared = pool.prepare_pool(st.pool(spark, sf_dir), st.SEEDS, method="md5")
    return pool.init_random(prepared, st.SEEDS, method="md5")


QUERIES["init_random"] = init_random
SQL["init_random"] = f"""WITH {SPLIT_SQL}
SELECT target, seed, mol_id, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY target, seed ORDER BY md5(CAST(seed AS VARCHAR) || '-init:' || CAST(mol_id AS VARCHAR)), mol_id) AS r
  FROM split WHERE split = 'pool') WHERE r <= 20"""

def init_diverse(spark, sf_dir):
    """Twenty centres per target and seed among the rows that are not held out."""
    prepared = shared_table(pool.prepare_pool(st.pool(spark, sf_dir), st.SEEDS, method="md5"), "pool")
    return pool.init_diverse(prepared, st.SEEDS, method="md5").select("target", "seed", "mol_id", "rank")


def _next_centre(step: int) -> str:
    """CTEs d<step>: distance to the nearest centre so far; c<step + 1>: the row farthest away."""
    near = "dist" if step == 1 else f"least(near{step - 1}, dist)"
    source = "rows" if step == 1 else f"d{step - 1}"
    return f"""
d{step} AS MATERIALIZED (SELECT r.* EXCLUDE (dist), {near} AS near{step} FROM (
  SELECT s.*, list_sum(list_transform(range(1, 65), lambda i: (s.features[i] - c.features[i]) * (s.features[i] - c.features[i]))) AS dist
  FROM {source} s JOIN c{step} c USING (target, seed)) r),
c{step + 1} AS MATERIALIZED (SELECT target, seed, mol_id, features FROM (
  SELECT *, row_number() OVER (PARTITION BY target, seed ORDER BY near{step} DESC, mol_id) AS r FROM d{step}) WHERE r = 1)"""


QUERIES["init_diverse"] = init_diverse
SQL["init_diverse"] = f"""WITH {SPLIT_SQL},
rows AS (SELECT s.seed, s.target, s.mol_id, p.features FROM split s JOIN pool p USING (target, mol_id) WHERE s.split = 'pool'),
c1 AS (SELECT target, seed, mol_id, features FROM (
  SELECT *, row_number() OVER (PARTITION BY target, seed ORDER BY md5(CAST(seed AS VARCHAR) || '-init:' || CAST(mol_id AS VARCHAR)), mol_id) AS r
  FROM rows) WHERE r = 1),
{", ".join(_next_centre(k) for k in range(1, pool.N_INITIAL))}
{" UNION ALL ".join(f"SELECT target, seed, mol_id, {k} AS rank FROM c{k}" for k in range(1, pool.N_INITIAL + 1))}"""

# Pool state: 20 initial rows and ten batches of ten, drawn by key ------------------------------


def labeled_rows(spark, sf_dir):
    rows = st.scored(spark, sf_dir).select(*KEYS, "mol_id").withColumn("_k", st.draw_key(F.col("seed"), F.col("mol_id")))
    drawn = top_k(rows, KEYS, [F.col("_k"), F.col("mol_id")], 120)
    batch = F.when(F.col("rank") <= 20, -1).otherwise(F.floor((F.col("rank") - 21) / 10))
    return drawn.select(*KEYS, "mol_id", batch.cast("int").alias("round_labeled"))


def state(spark, sf_dir):
    """Every pool row of every campaign, NULL = not labeled."""
    return st.scored(spark, sf_dir).join(labeled_rows(spark, sf_dir), [*KEYS, "mol_id"], "left")


STATE_SQL = f"""{st.SCORED_SQL},
state AS (SELECT seed, target, mol_id, label, p,
    CASE WHEN r <= 20 THEN -1 WHEN r <= 120 THEN CAST((r - 21) // 10 AS INTEGER) END AS round_labeled
  FROM (SELECT *, row_number() OVER (PARTITION BY seed, target ORDER BY {st.draw_sql('seed')}, mol_id) AS r FROM scored)),
open AS (SELECT * FROM state WHERE round_labeled IS NULL)"""


def open_rows(spark, sf_dir):
    return pool.unlabeled(st.scored(spark, sf_dir), labeled_rows(spark, sf_dir), [*KEYS, "mol_id"])


def rounded(df):
    return df.withColumn("p", F.round("p", 6))


QUERIES["unlabeled"] = lambda spark, sf_dir: open_rows(spark, sf_dir).select(*KEYS, "mol_id")
SQL["unlabeled"] = f"WITH {STATE_SQL} SELECT seed, target, mol_id FROM open"


def labeled_actives(spark, sf_dir):
    labels = st.pool(spark, sf_dir).select("target", "mol_id", "label")
    seen = pool.reveal_labels(labeled_rows(spark, sf_dir), labels, ["target", "mol_id"])
    return seen.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_labeled"), F.sum("label").alias("n_actives"))


QUERIES["labeled_actives"] = labeled_actives
SQL["labeled_actives"] = f"""WITH {STATE_SQL}
SELECT seed, target, count(*) AS n_labeled, CAST(sum(label) AS BIGINT) AS n_actives
FROM state WHERE round_labeled IS NOT NULL GROUP BY seed, target"""


def update_pool(spark, sf_dir):
    chosen = select.select_greedy(open_rows(spark, sf_dir), KEYS)
    before = state(spark, sf_dir).select(*KEYS, "mol_id", "round_labeled")
    return pool.update_pool(before, chosen, [*KEYS, "mol_id"], F.lit(10))


QUERIES["update_pool"] = update_pool
SQL["update_pool"] = f"""WITH {STATE_SQL},
chosen AS (SELECT *, row_number() OVER (PARTITION BY seed, target ORDER BY p DESC, mol_id) AS r FROM open)
SELECT s.seed, s.target, s.mol_id, coalesce(s.round_labeled, CASE WHEN c.r <= 10 THEN 10 END) AS round_labeled
FROM state s LEFT JOIN chosen c USING (seed, target, mol_id)"""

QUERIES["running_actives"] = lambda spark, sf_dir: pool.running_actives(state(spark, sf_dir), KEYS)
SQL["running_actives"] = f"""WITH {STATE_SQL},
per AS (SELECT seed, target, CAST(round_labeled + 1 AS INTEGER) AS round, count(*) AS n, sum(label) AS a
  FROM state WHERE round_labeled IS NOT NULL GROUP BY ALL)
SELECT seed, target, round, CAST(sum(n) OVER w AS BIGINT) AS n_labeled, CAST(sum(a) OVER w AS BIGINT) AS n_actives_found
FROM per WINDOW w AS (PARTITION BY seed, target ORDER BY round)"""

QUERIES["state_at_round"] = lambda spark, sf_dir: pool.state_at_round(state(spark, sf_dir), 5).select(*KEYS, "mol_id", "tag")
SQL["state_at_round"] = f"""WITH {STATE_SQL}
SELECT seed, target, mol_id, CASE WHEN round_labeled = -1 THEN 'Initial'
  WHEN round_labeled < 5 AND label = 1 THEN 'New active' WHEN round_labeled < 5 THEN 'New inactive' ELSE 'Untested' END AS tag
FROM state"""

QUERIES["truth_tags"] = lambda spark, sf_dir: pool.truth_tags(state(spark, sf_dir)).select(*KEYS, "mol_id", "truth_tag", "open_tag")
SQL["truth_tags"] = f"""WITH {STATE_SQL},
t AS (SELECT *, (CASE WHEN round_labeled IS NULL THEN 'unlabeled' ELSE 'labeled' END)
  || (CASE WHEN label = 1 THEN ' active' ELSE ' inactive' END) AS truth_tag FROM state)
SELECT seed, target, mol_id, truth_tag, CASE WHEN round_labeled IS NULL THEN 'unlabeled' ELSE truth_tag END AS open_tag FROM t"""

# Selection ------------------------------------------------------------------------------------

QUERIES["logistic_score"] = lambda spark, sf_dir: rounded(st.scored(spark, sf_dir))
SQL["logistic_score"] = f"WITH {st.SCORED_SQL} SELECT * REPLACE (round(p, 6) AS p) FROM scored"


def ranked_sql(order: str, k: int = 10) -> str:
    return f"""WITH {STATE_SQL}
SELECT seed, target, mol_id, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, target ORDER BY {order}, mol_id) AS r FROM open) WHERE r <= {k}"""


def ranks(df):
    return df.select(*KEYS, "mol_id", "rank")


QUERIES["select_random"] = lambda spark, sf_dir: ranks(
    select.select_random(open_rows(spark, sf_dir), KEYS, F.col("seed") + 3, method="md5")
)
SQL["select_random"] = ranked_sql(st.draw_sql("(seed + 3)"))

QUERIES["select_greedy"] = lambda spark, sf_dir: ranks(select.select_greedy(open_rows(spark, sf_dir), KEYS))
SQL["select_greedy"] = ranked_sql("p DESC")

QUERIES["select_topk"] = lambda spark, sf_dir: ranks(select.select_uncertainty_topk(open_rows(spark, sf_dir), KEYS))
SQL["select_topk"] = ranked_sql("abs(p - 0.5)")

QUERIES["select_score_low"] = lambda spark, sf_dir: ranks(
    select.select_by_score(open_rows(spark, sf_dir), KEYS, F.col("p"), 25, highest=False)
)
SQL["select_score_low"] = ranked_sql("p", 25)


def shortlist(spark, sf_dir):
    rows = open_rows(spark, sf_dir)
    near = select.select_uncertainty_topk(rows, KEYS, select.SHORTLIST)
    return rounded(select.restrict_to(rows, near, [*KEYS, "mol_id"])).select(*KEYS, "mol_id", "p")


QUERIES["shortlist"] = shortlist
SQL["shortlist"] = f"""WITH {STATE_SQL}
SELECT seed, target, mol_id, round(p, 6) AS p FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, target ORDER BY abs(p - 0.5), mol_id) AS r FROM open) WHERE r <= 100"""


def exclude_chosen(spark, sf_dir):
    rows = open_rows(spark, sf_dir)
    chosen = select.select_greedy(rows, KEYS)
    return select.exclude(rows, chosen, [*KEYS, "mol_id"]).select(*KEYS, "mol_id")


QUERIES["exclude_chosen"] = exclude_chosen
SQL["exclude_chosen"] = f"""WITH {STATE_SQL}
SELECT seed, target, mol_id FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, target ORDER BY p DESC, mol_id) AS r FROM open) WHERE r > 10"""


def select_diverse(spark, sf_dir):
    rows = open_rows(spark, sf_dir).join(st.pool(spark, sf_dir).select("mol_id", "features"), "mol_id")
    return ranks(select.select_uncertainty_diverse(rows, KEYS, F.col("seed") + 3))


QUERIES["select_diverse"] = select_diverse

# Committee of three fixed formulas ------------------------------------------------------------


def member_scores(spark, sf_dir):
    """seed, target, mol_id, member_p over the unlabeled rows."""
    at = lambda shift: F.element_at("features", F.col("seed") + 1 + shift)
    members = [F.struct(F.lit(f"m{i}").alias("member"), logistic_score(at(2 * i), at(2 * i + 1)).alias("p")) for i in range(3)]
    rows = open_rows(spark, sf_dir).join(st.pool(spark, sf_dir).select("mol_id", "features"), "mol_id")
    return rows.select(*KEYS, "mol_id", F.array(*members).alias("member_p"))


def _member_sql(i: int) -> str:
    a, b = f"features[seed + {2 * i + 1}]", f"features[seed + {2 * i + 2}]"
    return f"1.0 / (1.0 + exp(-(1.5 * {a} - {b} + 0.8 * {a} * {b})))"


MEMBERS_SQL = f"""{STATE_SQL},
long AS (SELECT o.seed, o.target, o.mol_id, unnest([{_member_sql(0)}, {_member_sql(1)}, {_member_sql(2)}]) AS mp
  FROM open o JOIN pool USING (mol_id)),
scores AS (SELECT seed, target, mol_id, var_pop(mp) AS disagreement FROM long GROUP BY ALL)"""


def disagreement(spark, sf_dir):
    long = committee.long_probabilities(member_scores(spark, sf_dir), [*KEYS, "mol_id"])
    return committee.disagreement(long, [*KEYS, "mol_id"])


def row_disagreement(spark, sf_dir):
    return committee.with_disagreement(member_scores(spark, sf_dir)).drop("member_p")


def rounded_disagreement(df):
    return df.withColumn("disagreement", F.round("disagreement", 8))


QUERIES["disagreement"] = lambda spark, sf_dir: rounded_disagreement(disagreement(spark, sf_dir))
SQL["disagreement"] = f"WITH {MEMBERS_SQL} SELECT * REPLACE (round(disagreement, 8) AS disagreement) FROM scores"

QUERIES["disagreement_rows"] = lambda spark, sf_dir: rounded_disagreement(row_disagreement(spark, sf_dir))
SQL["disagreement_rows"] = SQL["disagreement"]

QUERIES["select_qbc"] = lambda spark, sf_dir: ranks(select.select_query_by_committee(row_disagreement(spark, sf_dir), KEYS))
SQL["select_qbc"] = f"""WITH {MEMBERS_SQL}
SELECT seed, target, mol_id, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, target ORDER BY disagreement DESC, mol_id) AS r FROM scores) WHERE r <= 10"""


def disagreement_stats(spark, sf_dir):
    stats = committee.disagreement_stats(row_disagreement(spark, sf_dir), KEYS)
    return stats.select(*KEYS, *[F.round(f"{c}_disagreement", 8).alias(f"{c}_disagreement") for c in ("mean", "max", "median")])


QUERIES["disagreement_stats"] = disagreement_stats
SQL["disagreement_stats"] = f"""WITH {MEMBERS_SQL}
SELECT seed, target, round(avg(disagreement), 8) AS mean_disagreement, round(max(disagreement), 8) AS max_disagreement,
  round(median(disagreement), 8) AS median_disagreement FROM scores GROUP BY seed, target"""


def qbc_diagnostics(spark, sf_dir):
    scores = row_disagreement(spark, sf_dir)
    chosen = select.select_query_by_committee(scores, KEYS)
    rows = st.scored(spark, sf_dir).select(*KEYS, "mol_id", "label")
    return rounded_disagreement(committee.diagnostics(rows, scores, chosen, [*KEYS, "mol_id"]))


QUERIES["qbc_diagnostics"] = qbc_diagnostics
SQL["qbc_diagnostics"] = f"""WITH {MEMBERS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY seed, target ORDER BY disagreement DESC, mol_id) AS r FROM scores)
SELECT s.seed, s.target, s.mol_id, s.label, round(coalesce(r.disagreement, 0), 8) AS disagreement, coalesce(r.r <= 10, false) AS selected
FROM scored s LEFT JOIN r USING (seed, target, mol_id)"""


def disagreement_histogram(spark, sf_dir):
    rows = targets.histogram(row_disagreement(spark, sf_dir), KEYS, "disagreement", 30)
    return rows.withColumn("left_edge", F.round("left_edge", 8)).withColumn("right_edge", F.round("right_edge", 8))


QUERIES["disagreement_histogram"] = disagreement_histogram
SQL["disagreement_histogram"] = f"""WITH {MEMBERS_SQL},
b AS (SELECT seed, target, min(disagreement) AS lo, max(disagreement) AS hi FROM scores GROUP BY ALL)
SELECT seed, target, bin, round(lo + (hi - lo) / 30 * (bin - 1), 8) AS left_edge, round(lo + (hi - lo) / 30 * bin, 8) AS right_edge, count(*) AS n
FROM (SELECT seed, target, lo, hi, CAST(least(floor((disagreement - lo) / (hi - lo) * 30) + 1, 30) AS INTEGER) AS bin
  FROM scores JOIN b USING (seed, target)) GROUP BY ALL"""
