"""Registered queries: fingerprints, projection, neighbours, panels and the cleaning stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from poolspark.catalog import standins as st
from poolspark.catalog.modelling import full_run
from poolspark.functions.features import DEFAULT_BITS
from poolspark.operators import features, report, space
from poolspark.plans import panels
from poolspark.session import shared_dir, shared_table
from poolspark.sources.tables import spread
from poolspark.streaming.clean_stream import clean_stream, read_cleaned

QUERIES = {}
SQL = {}


def fingerprints(spark, sf_dir, method="md5", wanted=None):
    """Four-word shingles of whole texts; of the documents in ``wanted`` (doc_id), where given."""
    docs = spread(st.table(spark, sf_dir, "documents").select("doc_id", "text"))
    if wanted is not None:
        docs = docs.join(wanted.select("doc_id"), "doc_id", "left_semi")
    return features.featurize(docs, "text", unit="word", method=method).select("doc_id", "fp")


FP_SQL = r"""
words AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS g
  FROM words WHERE len(w) >= 4),
fps AS (SELECT doc_id, list_sort(list_distinct(list_transform(g, lambda x: CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) % 2048))) AS fp FROM grams)"""


def fingerprint(spark, sf_dir):
    bits = F.array_join(F.col("fp").cast("array<string>"), ",")
    return fingerprints(spark, sf_dir).select("doc_id", F.size("fp").alias("n_bits"), bits.alias("bits"))


QUERIES["fingerprint"] = fingerprint
SQL["fingerprint"] = f"""WITH {FP_SQL}
SELECT doc_id, CAST(len(fp) AS INTEGER) AS n_bits, array_to_string(fp, ',') AS bits FROM fps"""


def labelled_features(spark, sf_dir):
    """Documents with both a valid fingerprint and a label."""
    labels = st.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = features.align(fingerprints(spark, sf_dir), labels, ["doc_id"])
    return rows.select("doc_id", F.size("fp").alias("n_bits"), "label")


QUERIES["labelled_features"] = labelled_features
SQL["labelled_features"] = f"""WITH {FP_SQL}
SELECT doc_id, CAST(len(fp) AS INTEGER) AS n_bits, quality AS label FROM fps JOIN labels USING (doc_id)"""


def knn_jaccard(spark, sf_dir):
    edges = space.knn_jaccard(fingerprints(spark, sf_dir), row_id="doc_id")
    return edges.withColumn("dist", F.round("dist", 6))


QUERIES["knn_jaccard"] = knn_jaccard
SQL["knn_jaccard"] = f"""WITH {FP_SQL},
long AS (SELECT doc_id, unnest(fp) AS bit FROM fps),
shared AS (SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS n FROM long a JOIN long b USING (bit) GROUP BY 1, 2),
pairs AS (SELECT a.doc_id AS src, b.doc_id AS dst,
    1.0 - coalesce(n, 0) / CAST(len(a.fp) + len(b.fp) - coalesce(n, 0) AS DOUBLE) AS dist
  FROM fps a JOIN fps b ON a.doc_id <> b.doc_id LEFT JOIN shared s ON s.src = a.doc_id AND s.dst = b.doc_id)
SELECT src, dst, round(dist, 6) AS dist, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM pairs) WHERE r <= 15"""


def pca_variance(spark, sf_dir):
    """Explained variance of the components of each target."""
    _, variance = space.fit_pca(st.pool(spark, sf_dir))
    return variance.withColumns({c: F.round(c, 6) for c in ("explained", "cumulative")})


QUERIES["pca_variance"] = pca_variance


def covariances(spark, sf_dir):
    """The covariance of every two features in each target, from the blocks that the components are made of."""
    rows = st.pool(spark, sf_dir).select(F.col("target").alias("key"), "features")
    blocks = space.covariance_blocks(rows, block_columns=COVARIANCE_COLUMNS)
    cells = blocks.select(F.col("key").alias("target"), "i", "j", "n", F.size("mean_j").alias("w"), F.posexplode("block").alias("at", "cross"))
    first, second = F.col("i") * COVARIANCE_COLUMNS + F.floor(F.col("at") / F.col("w")), F.col("j") * COVARIANCE_COLUMNS + F.col("at") % F.col("w")
    placed = cells.select("target", first.cast("int").alias("a"), second.cast("int").alias("b"), F.round(F.col("cross") / (F.col("n") - 1), 6).alias("covariance"))
    return placed.where("a <= b")


COVARIANCE_COLUMNS = 24
QUERIES["covariances"] = covariances
SQL["covariances"] = f"""WITH {st.POOL_SQL},
x AS (SELECT target, mol_id, generate_subscripts(features, 1) AS a, unnest(features) AS v FROM pool)
SELECT p.target, CAST(p.a - 1 AS INTEGER) AS a, CAST(q.a - 1 AS INTEGER) AS b, round(covar_samp(p.v, q.v), 6) AS covariance
FROM x p JOIN x q ON p.target = q.target AND p.mol_id = q.mol_id AND p.a <= q.a GROUP BY ALL"""


def projection_rows(spark, sf_dir):
    projected, _ = space.fit_pca(st.pool(spark, sf_dir))
    return space.projection_rows(projected, ["target", "mol_id"]).withColumns({c: F.round(c, 6) for c in ("x", "y")})


QUERIES["projection_rows"] = projection_rows


def projection_panel(spark, sf_dir):
    """Projection rows annotated with the variance their two components explain together in their target."""
    rows, _, _ = panels.projection_panel(*space.fit_pca(st.pool(spark, sf_dir)))
    return rows.withColumns({c: F.round(c, 6) for c in ("x", "y", "variance")})


QUERIES["projection_panel"] = projection_panel


def neighbour_panel(spark, sf_dir):
    """The neighbour map of the labelled documents on the first two components of their fingerprints."""
    labels = st.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = shared_table(features.align(fingerprints(spark, sf_dir, wanted=labels), labels, ["doc_id"]), "labelled-bits")
    projected, _ = space.fit_pca(rows.withColumn("target", F.lit("documents")), 2, features="fp", n_bits=DEFAULT_BITS)
    drawn = panels.neighbour_panel(space.knn_jaccard(rows, row_id="doc_id"), projected, "doc_id")
    return drawn.withColumns({c: F.round(c, 6) for c in ("dist", "src_x", "src_y", "dst_x", "dst_y")})


QUERIES["neighbour_panel"] = neighbour_panel


def campaign_panel(spark, sf_dir):
    """The rows of the panels of all strategies, starts, seeds and rounds: pool rows once per target, then each campaign's marks."""
    projected, _ = space.fit_pca(st.pool(spark, sf_dir), 2)
    points, marks = panels.campaign_layers(full_run(spark, sf_dir), projected)
    rows = points.withColumn("tag", F.lit("Untested")).unionByName(marks, allowMissingColumns=True)
    shown = [F.round(c, 6).alias(c) for c in ("pc1", "pc2", "roc_auc_mean")]
    return rows.select("campaign", "target", "mol_id", "tag", "active", "from_round", F.col("strategy"), "initialization_strategy", *shown)


QUERIES["campaign_panel"] = campaign_panel


def experiment_card(spark, sf_dir):
    rows = st.pool(spark, sf_dir)
    _, variance = space.fit_pca(rows, 3)
    card = panels.experiment_card(rows, report.summarize(st.history(spark, sf_dir)), variance, 10)
    return card.withColumns(
        {c: F.round(c, 6) for c in ("active_fraction", "roc_auc_mean", "roc_auc_std", "variance_2", "variance_3")}
    )


QUERIES["experiment_card"] = experiment_card


def stream_clean(spark, sf_dir):
    """The cleaning stream over the raw table written as files; must equal the batch result."""
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    raw = st.raw_measurements(spark, sf_dir)
    raw.write.parquet(f"{base}/in")
    clean_stream(spark, f"{base}/in", raw.schema, f"{base}/out", f"{base}/checkpoint", st.ORDER)
    return read_cleaned(spark, f"{base}/out")


QUERIES["stream_clean"] = stream_clean
SQL["stream_clean"] = f"WITH {st.CLEAN_SQL} SELECT * FROM clean"
