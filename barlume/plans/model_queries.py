"""Queries over transforms, feature selection and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.operators import derived, information, regime, selection, transforms, validation
from barlume.plans.bar_queries import P, on_bars
from barlume.plans.catalogue import query
from barlume.plans.oracle import bars_sql, lag, r, rounded, with_bars
from barlume.sources import market

WEIGHTS = transforms.fracdiff_weights(0.4)
FRAC = " + ".join(f"{w!r}::DOUBLE * coalesce({lag('close', k)}, 0)" if k else "close" for k, w in enumerate(WEIGHTS))
on_bars("fracdiff", with_bars(f"SELECT symbol, ts, {r(FRAC, 'value')} FROM prev"), transforms.fracdiff)
STATS = "(SELECT avg(close) AS m, stddev_pop(close) AS s, min(close) AS lo, max(close) AS hi FROM bars)"
for _name, _value in [("nn", "(close - m) / s"), ("diffusion", "2 * (close - lo) / (hi - lo) - 1"), ("tree", "close")]:
    on_bars(f"scaler_{_name}", with_bars(f"SELECT symbol, ts, {r(_value, 'value')} FROM prev, {STATS}"), lambda b, n=_name: b.select("symbol", "ts", transforms.Scaler(n).fit(b, "close").transform(F.col("close")).alias("value")))
on_bars("feature_pipeline", with_bars(f"SELECT symbol, ts, {FRAC} AS q FROM prev", f"SELECT symbol, ts, {r('(q - m) / s', 'value')} FROM prev, {STATS}"), lambda b: transforms.FeaturePipeline("nn").fit(b).transform(b))
ROC = f"close / nullif({P}, 0) - 1"
on_bars("quantize", with_bars(f"SELECT symbol, ts, {ROC} AS q, close FROM prev", "SELECT symbol, ts, CASE WHEN q IS NOT NULL THEN CAST(round(least(greatest(q, -2147), 2147) * 1000000) AS BIGINT) END AS q_return, CAST(round(close * 100000) AS BIGINT) AS q_close FROM prev"),
        lambda b: derived.returns(b).select("symbol", "ts", transforms.quantize(F.col("return"), "return").alias("q_return"), transforms.quantize(F.col("close"), "sma").alias("q_close")))
on_bars("dequantize", with_bars("SELECT symbol, ts, round(CAST(round(close * 100000) AS BIGINT) / 100000.0, 6) + 0.0 AS close FROM prev"), lambda b: b.select("symbol", "ts", transforms.dequantize(transforms.quantize(F.col("close"), "sma"), "sma").alias("close")))
MONTH_HALF = "day(ts) <= 15"
on_bars("drift", with_bars(f"""SELECT 'close' AS feature, {r('abs(a - c) + abs(b - d)', 'statistic')}, 0.1::DOUBLE AS threshold, abs(a - c) + abs(b - d) > 0.1 AS drifted FROM
  (SELECT avg(close) FILTER (WHERE NOT {MONTH_HALF}) AS a, stddev_pop(close) FILTER (WHERE NOT {MONTH_HALF}) AS b, avg(close) FILTER (WHERE {MONTH_HALF}) AS c, stddev_pop(close) FILTER (WHERE {MONTH_HALF}) AS d FROM prev)"""),
  lambda b: transforms.drift(b.filter(f"NOT {MONTH_HALF}"), b.filter(MONTH_HALF), "close"))
SAMPLE = "(SELECT symbol, ts, close AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars)"
on_bars("sample_entropy", f"""WITH {bars_sql()}, x AS (SELECT *, 0.2 * stddev_pop(v) OVER (PARTITION BY symbol) AS tol, count(*) OVER (PARTITION BY symbol) AS n,
    lead(v, 1) OVER (PARTITION BY symbol ORDER BY i) AS v1, lead(v, 2) OVER (PARTITION BY symbol ORDER BY i) AS v2 FROM {SAMPLE}),
  p AS (SELECT a.symbol, count(*) FILTER (WHERE a.i <= a.n - 2 AND b.i <= b.n - 2) AS m2,
    count(*) FILTER (WHERE a.i <= a.n - 3 AND b.i <= b.n - 3 AND abs(a.v2 - b.v2) <= a.tol) AS m3
    FROM x a JOIN x b ON a.symbol = b.symbol AND a.i < b.i AND abs(a.v - b.v) <= a.tol AND abs(a.v1 - b.v1) <= a.tol GROUP BY 1)
  SELECT symbol, {r('CASE WHEN m2 > 0 AND m3 > 0 THEN -ln(m3::DOUBLE / m2) ELSE 0 END', 'value')} FROM p""", lambda b: transforms.sample_entropy(b, "close"))  # fmt: skip
on_bars("hurst", f"""WITH {bars_sql()}, x AS (SELECT symbol, v, i - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM {SAMPLE}),
  t AS (SELECT symbol, v, i, tau, i // tau AS g FROM x, (SELECT unnest([2, 4, 8, 16]) AS tau) WHERE n >= 20 AND i // tau < n // tau),
  c AS (SELECT *, v - avg(v) OVER (PARTITION BY symbol, tau, g) AS a FROM t), s AS (SELECT *, sum(a) OVER (PARTITION BY symbol, tau, g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM c),
  q AS (SELECT symbol, tau, g, max(s) - min(s) AS r, stddev_pop(a) AS d FROM s GROUP BY 1, 2, 3), h AS (SELECT symbol, tau, avg(ln(r / d)) / ln(tau) AS h FROM q WHERE d > 0 AND r > 0 GROUP BY 1, 2)
  SELECT symbol, {r('avg(h)', 'value')} FROM h GROUP BY 1""", lambda b: transforms.hurst_exponent(b, "close"))  # fmt: skip

# ---- selection, over the line items' numbers

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = selection.pairs(FEATURES)


def items(spark, sf_dir):  # noqa: ANN001, ANN201
    return market.table(spark, sf_dir, "lineitem")


def corr_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, {r(f'corr({a}, {b})', 'corr')} FROM {source}" for a, b in PAIRS)


@query("pearson_long", corr_sql("lineitem"))
def pearson_long(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(selection.correlation_pairs(items(spark, sf_dir), FEATURES))


RANKED = "k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0::DOUBLE AS {f}" for f in FEATURES) + " FROM lineitem)"


@query("spearman_long", f"WITH {RANKED} {corr_sql('k')}")
def spearman_long(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(selection.spearman_pairs(items(spark, sf_dir), FEATURES))


OHLC = ["open", "high", "low", "close"]
OHLC_SQL = " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, {r(f'corr({a}, {b})', 'corr')} FROM prev" for a, b in selection.pairs(OHLC))
on_bars("correlated_pairs", with_bars(f"SELECT * FROM ({OHLC_SQL}) WHERE f1 <> f2 AND abs(corr) >= 0.2"), lambda b: selection.highly_correlated_pairs(selection.correlation_pairs(b, OHLC), 0.2))


@query("fdr_bh", f"""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE ((c_custkey * 7919) % 10007) / 100070.0::DOUBLE END AS p FROM customer),
  k AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p) AS i FROM p WHERE p IS NOT NULL), q AS (SELECT *, least(min(p * n / i) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM k)
  SELECT c_custkey, {r('q', 'q_value')}, q < 0.05 AS significant FROM p LEFT JOIN q USING (c_custkey)""")
def fdr_bh(spark, sf_dir):  # noqa: ANN001, ANN201
    p = market.table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE ((c_custkey * 7919) % 10007) / 100070.0D END AS p")
    return rounded(selection.benjamini_hochberg(p, "p").select("c_custkey", "q_value", "significant"))


@query("cohens_d", f"""WITH m AS (SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS n1, count(*) FILTER (WHERE l_returnflag = 'N') AS n2, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS m1, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS m2,
  var_samp(l_quantity) FILTER (WHERE l_returnflag = 'A') AS v1, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'N') AS v2 FROM lineitem), p AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS s FROM m)
  SELECT {r('s', 'pooled_std')}, {r('m1 - m2', 'mean_diff')}, {r('(m1 - m2) / s', 'cohens_d')}, CASE WHEN abs((m1 - m2) / s) < 0.2 THEN 'negligible' WHEN abs((m1 - m2) / s) < 0.5 THEN 'small' WHEN abs((m1 - m2) / s) < 0.8 THEN 'medium' ELSE 'large' END AS interpretation FROM p""")
def cohens_d(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(selection.cohens_d(items(spark, sf_dir), "l_returnflag", "l_quantity", "A", "N"))


MRMR = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def mrmr_sql() -> str:
    """One table a step: the best of the features that no step before has taken."""
    every = [*MRMR, "l_extendedprice"]
    c = " UNION ALL ".join(f"SELECT '{a}' AS f, '{b}' AS g, abs(corr({a}, {b})) AS c FROM lineitem" for a in MRMR for b in every if a != b)
    steps = []
    for i in range(len(MRMR)):
        past = " UNION ALL ".join(f"SELECT f FROM s{j}" for j in range(i))
        less = f" - (SELECT avg(c) FROM c x WHERE x.f = c.f AND x.g IN ({past}))" if i else ""
        steps.append(f"s{i} AS MATERIALIZED (SELECT f, c{less} AS score FROM c WHERE g = 'l_extendedprice'{f' AND f NOT IN ({past})' if i else ''} ORDER BY score DESC, f LIMIT 1)")
    return f"WITH c AS MATERIALIZED ({c}), " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT {i + 1} AS rank, f AS feature, {r('score', 'score')} FROM s{i}" for i in range(len(MRMR)))


@query("mrmr_rank", mrmr_sql())
def mrmr_rank(spark, sf_dir):  # noqa: ANN001, ANN201
    chosen = selection.mrmr(items(spark, sf_dir), "l_extendedprice", MRMR, 4)
    return rounded(spark.createDataFrame([(i + 1, f, s) for i, (f, s) in enumerate(chosen)], "rank int, feature string, score double"))


@query("cohens_d_batch", "WITH m AS (" + " UNION ALL ".join(f"""SELECT '{f}' AS feature, count(*) FILTER (WHERE l_returnflag = 'A') AS n1, count(*) FILTER (WHERE l_returnflag = 'N') AS n2, avg({f}) FILTER (WHERE l_returnflag = 'A') AS m1, avg({f}) FILTER (WHERE l_returnflag = 'N') AS m2,
  var_samp({f}) FILTER (WHERE l_returnflag = 'A') AS v1, var_samp({f}) FILTER (WHERE l_returnflag = 'N') AS v2 FROM lineitem""" for f in MRMR) + f"""), p AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM m),
  e AS (SELECT *, 1.959963984540054::DOUBLE * sqrt((n1 + n2) / (n1 * n2)::DOUBLE + d * d / (2 * (n1 + n2))) AS h FROM p) SELECT feature, {r('d', 'cohens_d')}, {r('d - h', 'low')}, {r('d + h', 'high')} FROM e""")
def cohens_d_batch(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(selection.cohens_d_batch(items(spark, sf_dir), "l_returnflag", MRMR, "A", "N").select("feature", "cohens_d", "low", "high"))


@query("information_matrix")
def information_matrix(spark, sf_dir):  # noqa: ANN001, ANN201
    return selection.information_matrix(numbered_bars(spark, sf_dir), "n", BAR_FEATURES, by=["symbol"])


@query("mi_paired_difference")
def mi_paired_difference(spark, sf_dir):  # noqa: ANN001, ANN201
    return validation.paired_targets(numbered_bars(spark, sf_dir), "n", BAR_FEATURES, "target", "midrange", by=["symbol"])


@query("out_of_sample")
def out_of_sample(spark, sf_dir):  # noqa: ANN001, ANN201
    return validation.split_validation(numbered_bars(spark, sf_dir), "n", BAR_FEATURES, "target", top=2, by=["symbol"])


@query("mi_sensitivity")
def mi_sensitivity(spark, sf_dir):  # noqa: ANN001, ANN201
    return validation.k_sensitivity(numbered_bars(spark, sf_dir), "n", BAR_FEATURES, "target", by=["symbol"])


@query("mi_significance")
def mi_significance(spark, sf_dir):  # noqa: ANN001, ANN201
    return validation.two_target_report(numbered_bars(spark, sf_dir), "n", BAR_FEATURES, "target", "midrange", by=["symbol"])


@query("effect_sizes")
def effect_sizes(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = items(spark, sf_dir)
    return validation.effect_sizes(rows, F.xxhash64("l_orderkey", "l_linenumber"), "l_returnflag", MRMR, "A", "N")


#: Yesterday's return as the forecast of today's, for closes and for midranges.
SHARPE = "avg(sign({p}) * {y}) / nullif(stddev_pop(sign({p}) * {y}), 0)"


@query("model_comparison", with_bars(
    "SELECT symbol, ts, close / lag(close) OVER w - 1 AS c, (high + low) / lag(high + low) OVER w - 1 AS m FROM prev WINDOW w AS (PARTITION BY symbol ORDER BY ts)",
    "SELECT symbol, c, m, lag(c) OVER w AS cp, lag(m) OVER w AS mp FROM prev WINDOW w AS (PARTITION BY symbol ORDER BY ts)",
    f"""SELECT symbol, n, {r("c_mae", "first_mae")}, {r("m_mae", "second_mae")}, {r("c_rmse", "first_rmse")}, {r("c_dir", "first_directional")}, {r("m_sharpe - c_sharpe", "sharpe_improvement")}, {r("(c_mae - m_mae) / c_mae", "mae_improvement")} FROM (
  SELECT symbol, count(*) AS n, avg(abs(cp - c)) AS c_mae, avg(abs(mp - m)) AS m_mae, sqrt(avg((cp - c) * (cp - c))) AS c_rmse, avg(CASE WHEN sign(cp) = sign(c) THEN 1.0 ELSE 0.0 END) AS c_dir,
  {SHARPE.format(p="cp", y="c")} AS c_sharpe, {SHARPE.format(p="mp", y="m")} AS m_sharpe FROM prev WHERE c IS NOT NULL AND m IS NOT NULL AND cp IS NOT NULL AND mp IS NOT NULL GROUP BY 1)"""))
def model_comparison(spark, sf_dir):  # noqa: ANN001, ANN201
    w = "OVER (PARTITION BY symbol ORDER BY ts)"
    b = market.bars(spark, sf_dir).selectExpr("symbol", "ts", f"try_divide(close, lag(close) {w}) - 1 AS c", f"try_divide(high + low, lag(high + low) {w}) - 1 AS m").selectExpr("*", f"lag(c) {w} AS cp", f"lag(m) {w} AS mp")
    out = validation.model_comparison(b, ("c", "cp"), ("m", "mp"), ["symbol"])
    return rounded(out.select("symbol", "n", "first_mae", "second_mae", "first_rmse", "first_directional", "sharpe_improvement", "mae_improvement"))


def numbered_bars(spark, sf_dir):  # noqa: ANN001, ANN201
    """All bars with features and a target, numbered from 0 within their symbol."""
    b = derived.derived_fields(market.bars(spark, sf_dir)).selectExpr("*", "row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS n")
    return b.selectExpr("symbol", "n", "open", "range", "true_range", "volume", "close AS target", "midrange").filter("target IS NOT NULL")


BAR_FEATURES = ["open", "range", "true_range", "volume"]


@query("mutual_information")
def mutual_information(spark, sf_dir):  # noqa: ANN001, ANN201
    return selection.mutual_information(numbered_bars(spark, sf_dir), "n", BAR_FEATURES, "target", by=["symbol"])


@query("large_information")
def large_information(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = items(spark, sf_dir).selectExpr("l_orderkey * 8 + l_linenumber AS row", "l_quantity", "l_discount", "l_extendedprice")
    return information.large_information(rows, "row", ["l_quantity", "l_discount"], "l_extendedprice")


@query("mi_bootstrap")
def mi_bootstrap(spark, sf_dir):  # noqa: ANN001, ANN201
    return selection.resampled_information(numbered_bars(spark, sf_dir), "n", BAR_FEATURES, "target", "bootstrap", by=["symbol"])


@query("mi_permutation")
def mi_permutation(spark, sf_dir):  # noqa: ANN001, ANN201
    return selection.resampled_information(numbered_bars(spark, sf_dir), "n", BAR_FEATURES, "target", "permutation", by=["symbol"])


@query("rolling_mi")
def rolling_mi(spark, sf_dir):  # noqa: ANN001, ANN201
    found = selection.rolling_information(numbered_bars(spark, sf_dir), "n", BAR_FEATURES, "target", 120, 60, by=["symbol"])
    return selection.rank_stability(found, "window", "feature", "mi", by=["symbol"])


# ---- regimes, over the embeddings


def embeddings(spark, sf_dir):  # noqa: ANN001, ANN201
    return market.table(spark, sf_dir, "embeddings")


LONG = "x AS (SELECT vec_id AS row, label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS dim FROM embeddings)"


@query("nearest_centroid", f"""WITH {LONG}, m AS (SELECT dim, avg(value) AS m, stddev_pop(value) AS s FROM x GROUP BY 1), z AS (SELECT row, label, dim, coalesce((value - m) / nullif(s, 0), 0) AS z FROM x JOIN m USING (dim)),
  c AS (SELECT label AS class, dim, avg(z) AS c FROM z GROUP BY 1, 2), d AS (SELECT row, class, sqrt(sum((z - c) * (z - c))) AS d FROM z JOIN c USING (dim) GROUP BY 1, 2)
  SELECT row, arg_min(class, d) AS prediction, {r('exp(-min(d)) / sum(exp(-d))', 'confidence')} FROM d GROUP BY 1""")
def nearest_centroid(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(regime.nearest_centroid(embeddings(spark, sf_dir), "vec_id", "embedding", "label"))


@query("cluster_quality", f"""WITH {LONG}, c AS (SELECT label, dim, avg(value) AS c, count(*) AS n FROM x GROUP BY 1, 2), d AS (SELECT row, x.label, c.label AS other, sqrt(sum((value - c) * (value - c))) AS d FROM x JOIN c USING (dim) GROUP BY 1, 2, 3),
  o AS (SELECT row, label, d AS a FROM d WHERE label = other), b AS (SELECT row, min(d) AS b FROM d WHERE label <> other GROUP BY 1), s AS (SELECT label, avg(a) AS s, sum(a * a) AS w, count(*) AS n FROM o GROUP BY 1),
  p AS (SELECT i.label AS i, j.label AS j, sqrt(sum((i.c - j.c) * (i.c - j.c))) AS m FROM c i JOIN c j USING (dim) WHERE i.label <> j.label GROUP BY 1, 2),
  db AS (SELECT avg(q) AS v FROM (SELECT i, max((si.s + sj.s) / m) AS q FROM p JOIN s si ON si.label = i JOIN s sj ON sj.label = j GROUP BY 1)), g AS (SELECT dim, avg(value) AS g FROM x GROUP BY 1),
  bt AS (SELECT sum(n * (c - g) * (c - g)) AS v FROM c JOIN g USING (dim)), t AS (SELECT sum(w) AS w, sum(n) AS n, count(*) AS k, min(n) / sum(n) AS f, count(*) FILTER (WHERE n = 1) AS z FROM s)
  SELECT {r('db.v', 'davies_bouldin')}, {r('(bt.v / (k - 1)) / (w / (n - k))', 'calinski_harabasz')}, {r('f', 'min_cluster_fraction')}, CAST(z AS BIGINT) AS n_singletons,
  {r('(SELECT avg((b - a) / greatest(a, b)) FROM o JOIN b USING (row))', 'simplified_silhouette')} FROM db, bt, t""")
def cluster_quality(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(regime.cluster_quality(embeddings(spark, sf_dir), "vec_id", "embedding", "label"))


@query("adjusted_rand", f"""WITH e AS (SELECT label AS a, (label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10 AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM e GROUP BY 1, 2),
  t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS i, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS j, (SELECT sum(n) FROM c) AS n)
  SELECT {r('(ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2))', 'ari')} FROM t""")
def adjusted_rand(spark, sf_dir):  # noqa: ANN001, ANN201
    e = embeddings(spark, sf_dir).selectExpr("label AS a", "(label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10 AS b")
    return rounded(regime.adjusted_rand(e, "a", "b"))


@query("terminal_coverage", f"SELECT label, {r('coalesce(n / (SELECT count(*) FROM embeddings), 0)', 'coverage')} FROM (SELECT unnest(range(12))::INTEGER AS label) LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) USING (label)")
def terminal_coverage(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(regime.terminal_coverage(embeddings(spark, sf_dir), "label", list(range(12))))


@query("kmeans_regimes")
def kmeans_regimes(spark, sf_dir):  # noqa: ANN001, ANN201
    return regime.kmeans_regimes(embeddings(spark, sf_dir).select("vec_id", "embedding"), "embedding", 10).select("vec_id", "cluster_id")


@query("gmm_regimes")
def gmm_regimes(spark, sf_dir):  # noqa: ANN001, ANN201
    return regime.gmm_regimes(numbered_bars(spark, sf_dir), ["range", "volume"], 3).select("symbol", "n", "cluster_id", "probabilities")


@query("svm_regimes")
def svm_regimes(spark, sf_dir):  # noqa: ANN001, ANN201
    e = embeddings(spark, sf_dir)
    return regime.svm_regimes(e, e, "embedding", "label").select("vec_id", "label", "prediction")


#: Probabilities with every defect, from the row's number alone.
ASSIGNED = [
    "vec_id", "CASE WHEN vec_id % 11 = 3 THEN NULL WHEN vec_id % 13 = 4 THEN 3 ELSE CAST(vec_id % 3 AS INTEGER) END AS cluster", "CASE WHEN vec_id % 7 = 2 THEN CAST(1.25 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS regime_0",
    "CASE WHEN vec_id % 17 = 5 THEN NULL ELSE CAST(0.25 AS DOUBLE) END AS regime_1", "CASE WHEN vec_id % 5 = 1 THEN CAST(0.125 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS regime_2",
]


@query("regime_violations", f"""WITH a AS (SELECT {", ".join(ASSIGNED)} FROM embeddings), j AS (SELECT vec_id, CASE WHEN cluster IS NULL OR cluster NOT BETWEEN 0 AND 2 THEN 'cluster'
  WHEN regime_0 > 1 OR regime_1 IS NULL THEN 'probability' WHEN abs(regime_0 + regime_1 + regime_2 - 1) > 1e-6 THEN 'sum' END AS reason FROM a) SELECT * FROM j WHERE reason IS NOT NULL""")
def regime_violations(spark, sf_dir):  # noqa: ANN001, ANN201
    return regime.invalid_assignments(embeddings(spark, sf_dir).selectExpr(*ASSIGNED), "cluster", ["regime_0", "regime_1", "regime_2"]).select("vec_id", "reason")
