"""Queries over the bootstraps of regimes, kernel machines and silhouettes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.functions.arrays import at_length_one, dot, doubles, literal, unit
from barlume.operators import bootstraps, kernel, regime
from barlume.plans.catalogue import query
from barlume.plans.model_queries import embeddings
from barlume.plans.oracle import r, rounded
from barlume.sources import market

UNIT = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings),
  s AS (SELECT label, i, sum(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM u) GROUP BY 1, 2),
  p AS (SELECT label AS j, list(x / n ORDER BY i) AS p FROM s JOIN (SELECT label, sqrt(sum(x * x)) AS n FROM s GROUP BY 1) USING (label) GROUP BY 1),
  c AS (SELECT vec_id, j, list_sum(list_transform(list_zip(e, p), lambda z: z[1] * z[2])) AS c FROM u, p)"""


def class_directions(spark, sf_dir):  # noqa: ANN001, ANN201
    """The embeddings at length 1, and each label's sum of them at length 1, in order of labels."""
    e = embeddings(spark, sf_dir).select("vec_id", "label", doubles("embedding").alias("x")).withColumn("e", unit("x")).drop("x")
    classes = regime.labels_of(e, "label")
    return e, classes, at_length_one(regime.class_sums(e, "e", "label", classes)[1])


@query("sinkhorn_assignments", f"""WITH {UNIT}, a0 AS (SELECT vec_id, j, exp((c - max(c) OVER (PARTITION BY vec_id)) / 0.1) + 1e-12 AS a FROM c)
  """ + "".join(f""", r{i} AS (SELECT vec_id, j, a / sum(a) OVER (PARTITION BY vec_id) AS a FROM a{i}), a{i + 1} AS (SELECT vec_id, j, a / sum(a) OVER (PARTITION BY j) AS a FROM r{i})""" for i in range(3)) + f""",
  f AS (SELECT vec_id, j, a / sum(a) OVER (PARTITION BY vec_id) AS a FROM a3) SELECT vec_id, arg_max(j, a) AS label, {r('max(a)', 'share')} FROM f GROUP BY 1""")
def sinkhorn_assignments(spark, sf_dir):  # noqa: ANN001, ANN201
    e, classes, p = class_directions(spark, sf_dir)
    a = bootstraps.with_assignments(e, "e", p, bootstraps.sinkhorn_columns(e, "e", p, 0.1, 3))
    top = F.array_max("__a")
    return rounded(a.select("vec_id", F.get(F.array(*[F.lit(c) for c in classes]), F.array_position("__a", top).cast("int") - 1).alias("label"), top.alias("share")))


@query("balanced_labels", f"""WITH RECURSIVE {UNIT}, d AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY j) - 1 AS INTEGER) AS j, round(1 - c, 6) AS d FROM c),
  o AS (SELECT vec_id, list(j ORDER BY d, j) AS prefers, min(d) AS least FROM d GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY least, vec_id) AS i FROM o),
  k AS (SELECT count(*) AS n, (SELECT count(*) FROM p) AS k FROM o),
  g AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS vec_id, NULL::INTEGER AS cluster_id, list_transform(range(k), lambda j: n // k + CASE WHEN j < n % k THEN 1 ELSE 0 END) AS free FROM k
    UNION ALL SELECT i, vec_id, t, list_transform(free, lambda f, x: CASE WHEN x = t + 1 THEN f - 1 ELSE f END)
    FROM (SELECT n.i, n.vec_id, g.free, list_filter(n.prefers, lambda j: g.free[j + 1] > 0)[1] AS t FROM g JOIN n ON n.i = g.i + 1))
  SELECT vec_id, cluster_id FROM g WHERE i > 0""")
def balanced_labels(spark, sf_dir):  # noqa: ANN001, ANN201
    e, _, p = class_directions(spark, sf_dir)
    d = e.select("vec_id", F.array(*[F.round(1 - dot("e", literal(x)), 6) for x in p]).alias("d"))
    return bootstraps.balanced_labels(d, "vec_id", "d").select("vec_id", "cluster_id")


@query("silhouettes", f"""WITH s AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s, count(*) AS n FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
  m AS (SELECT vec_id, max(s / (n - 1)) FILTER (WHERE own = other AND n > 1) AS a, min(s / n) FILTER (WHERE own <> other) AS b FROM s GROUP BY 1)
  SELECT vec_id, {r('CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END', 'silhouette')} FROM m""")
def silhouettes(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(regime.silhouettes(embeddings(spark, sf_dir), "vec_id", "embedding", "label"))


@query("prototype_regimes")
def prototype_regimes(spark, sf_dir):  # noqa: ANN001, ANN201
    return bootstraps.prototype_regimes(embeddings(spark, sf_dir), "vec_id", "embedding", 10)


@query("embedding_regimes")
def embedding_regimes(spark, sf_dir):  # noqa: ANN001, ANN201
    e = embeddings(spark, sf_dir).select("vec_id", "embedding")
    return bootstraps.embedding_regimes(e, bootstraps.PrincipalEncoder("embedding"), 10, fit_encoder=True).select("vec_id", "cluster_id")


@query("temporal_regimes")
def temporal_regimes(spark, sf_dir):  # noqa: ANN001, ANN201
    bars = market.bars(spark, sf_dir)
    encoder = bootstraps.TemporalEncoder("symbol", "ts", ["open", "high", "low", "close"]).fit(bars)
    found = bootstraps.embedding_regimes(bars, encoder, 3)
    return found.select("symbol", "ts", "cluster_id", *[F.lit(float(x)).alias(n) for n, x in (("positive", encoder.positive), ("negative", encoder.negative), ("loss", encoder.loss))])


@query("kernel_regimes")
def kernel_regimes(spark, sf_dir):  # noqa: ANN001, ANN201
    e = embeddings(spark, sf_dir)
    return kernel.KernelClassifier(10).fit(e, "embedding", "label", "vec_id").predict(e, "embedding").select("vec_id", "label", "prediction", "probabilities")
