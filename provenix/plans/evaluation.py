"""Evaluation measures (A9 to A22, A31 to A34): risk score against whether the item is derived from another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.operators import evaluation as ev
from provenix.plans.common import items, mi
from provenix.plans.registry import Registry

REG = Registry()

_EV = mi("risk_score", "parent_id", "mime_type", "file_size", "integrity_score", "width") + ", ev AS (SELECT id, risk_score AS s, risk_score / 100.0::DOUBLE AS p, (parent_id IS NOT NULL)::INT AS y, mime_type AS g, file_size, integrity_score, width FROM mi)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir, "risk_score", "parent_id", "mime_type", "file_size", "integrity_score", "width")
    return d.select("id", F.col("risk_score").alias("s"), (F.col("risk_score") / 100.0).alias("p"), F.col("parent_id").isNotNull().cast("int").alias("y"), F.col("mime_type").alias("g"), "file_size", "integrity_score", "width")


_COUNTS = "count_if(s > {t} AND y = 1)::BIGINT AS tp, count_if(NOT s > {t} AND y = 0)::BIGINT AS tn, count_if(s > {t} AND y = 0)::BIGINT AS fp, count_if(NOT s > {t} AND y = 1)::BIGINT AS fn"
_RATES = ", ".join(f"round(coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0), 6) AS {k}" for k, a, b in (
    ("accuracy", "tp + tn", "tp + tn + fp + fn"), ("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"), ("f1", "2 * tp", "2 * tp + fp + fn"), ("specificity", "tn", "tn + fp"), ("fpr", "fp", "fp + tn"), ("fnr", "fn", "fn + tp")))


@REG.query(_EV + f" SELECT {_COUNTS.format(t=35)} FROM ev")
def a9_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).agg(*ev.confusion(F.col("s") > 35, F.col("y")))


@REG.query(_EV + f", c AS (SELECT {_COUNTS.format(t=35)} FROM ev) SELECT tp, tn, fp, fn, {_RATES} FROM c")
def a10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.rates(scored(spark, sf_dir).agg(*ev.confusion(F.col("s") > 35, F.col("y"))))


@REG.query(_EV + f", c AS (SELECT g, {_COUNTS.format(t=35)} FROM ev GROUP BY g) SELECT g, tp, tn, fp, fn, {_RATES} FROM c")
def a11_rates_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.rates(scored(spark, sf_dir).groupBy("g").agg(*ev.confusion(F.col("s") > 35, F.col("y"))))


_CUM = """, v AS (SELECT s::DOUBLE AS v, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM ev WHERE s IS NOT NULL GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY v) AS cp, sum(neg) OVER (ORDER BY v) AS cn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM v)"""


@REG.query(_EV + _CUM + " SELECT round(coalesce(sum(pos * (cn - neg / 2)) / nullif(max(tp) * max(tn), 0), 0), 6) AS auc FROM c")
def a12_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.auc(scored(spark, sf_dir), "s", "y")


@REG.query(_EV + _CUM + """ SELECT v AS threshold, round((tp - cp) / tp, 6) AS tpr, round((tn - cn) / tn, 6) AS fpr FROM c
UNION ALL SELECT min(v) - 1, 1, 1 FROM c UNION ALL SELECT max(v) + 1, 0, 0 FROM c""")
def a13_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.roc(scored(spark, sf_dir), "s", "y")


@REG.query(_EV + f""", t AS (SELECT unnest(range(5, 96, 5)) AS t), c AS (SELECT t.t::DOUBLE AS threshold, {_COUNTS.format(t='t.t')} FROM ev, t GROUP BY t.t) SELECT threshold, tp, tn, fp, fn, {_RATES} FROM c""")
def a14_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sweep(scored(spark, sf_dir), "s", "y", list(range(5, 96, 5)))


@REG.query(_EV + f""", t AS (SELECT unnest(range(5, 96, 5)) AS t), c AS (SELECT t.t::DOUBLE AS threshold, {_COUNTS.format(t='t.t')} FROM ev, t GROUP BY t.t), r AS (SELECT threshold, tp, tn, fp, fn, {_RATES} FROM c)
SELECT threshold, f1 FROM r ORDER BY f1 DESC, threshold LIMIT 1""")
def a14_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sweep(scored(spark, sf_dir), "s", "y", list(range(5, 96, 5))).orderBy(F.desc("f1"), "threshold").select("threshold", "f1").limit(1)


@REG.query(_EV + """, t AS (SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS t), c AS (SELECT t.t AS threshold, g, count_if(p >= t.t AND y = 1) AS tp, count_if(p < t.t AND y = 1) AS fn, count_if(p >= t.t AND y = 0) AS fp, count_if(p < t.t AND y = 0) AS tn FROM ev, t GROUP BY ALL),
r AS (SELECT threshold, sum(tp)::DOUBLE / nullif(sum(tp) + sum(fn), 0) AS recall, avg(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0)) AS mean_fpr FROM c GROUP BY 1)
SELECT threshold, round(recall, 6) AS recall, round(mean_fpr, 6) AS mean_fpr FROM r WHERE recall >= 0.85 ORDER BY round(mean_fpr, 9), threshold LIMIT 1""")
def a15_constrained_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold of least mean false-positive rate over the groups among those with recall of 0.85 or more."""
    c = ev.sweep(scored(spark, sf_dir), "p", "y", [i / 100 for i in range(1, 100)], strict=False, by=["g"])
    fpr = F.coalesce(F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn")), F.lit(0.0))
    r = c.groupBy("threshold").agg(F.try_divide(F.sum("tp").cast("double"), F.sum("tp") + F.sum("fn")).alias("recall"), F.avg(fpr).alias("mean_fpr"))
    return r.where("recall >= 0.85").orderBy(F.round("mean_fpr", 9), "threshold").limit(1).select("threshold", F.round("recall", 6).alias("recall"), F.round("mean_fpr", 6).alias("mean_fpr"))


_EDGES = "[" + ", ".join(f"{i}::DOUBLE * 0.1::DOUBLE" for i in range(1, 10)) + "]"


def _bins(p: str, keys: str = "") -> str:
    return f"SELECT {keys}len(list_filter({_EDGES}, lambda e: {p} >= e))::INT AS bin, count(*) AS n, avg({p}) AS confidence, avg(y) AS accuracy"


@REG.query(_EV + f", b AS ({_bins('p')} FROM ev WHERE p IS NOT NULL GROUP BY 1) SELECT i::INT AS bin, coalesce(n, 0) AS n, round(coalesce(confidence, 0), 6) AS confidence, round(coalesce(accuracy, 0), 6) AS accuracy FROM range(10) r(i) LEFT JOIN b ON b.bin = i")
def a16_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.reliability(scored(spark, sf_dir), "p", "y").select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@REG.query(_EV + f", b AS ({_bins('p')} FROM ev WHERE p IS NOT NULL GROUP BY 1) SELECT round(coalesce(sum(n * abs(confidence - accuracy)) / sum(n), 0), 6) AS ece FROM b")
def a16_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.ece(ev.reliability(scored(spark, sf_dir), "p", "y"))


@REG.query(_EV + """ SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(-avg(y * ln(greatest(0.000001, p)) + (1 - y) * ln(greatest(0.000001, 1 - p))), 6) AS nll FROM ev""")
def a17_brier_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    nll = -F.avg(y * F.log(F.greatest(F.lit(1e-6), p)) + (1 - y) * F.log(F.greatest(F.lit(1e-6), 1 - p)))
    return scored(spark, sf_dir).agg(F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(nll, 6).alias("nll"))


@REG.query(_EV + f""", q AS (SELECT t AS temperature, y, 1 / (1 + exp(-ln(greatest(0.01, least(0.99, p)) / (1 - greatest(0.01, least(0.99, p)))) / t)) AS tp FROM ev, (SELECT unnest([2.0, 4.0, 6.0, 8.0, 10.0, 12.0])::DOUBLE AS t) WHERE p IS NOT NULL),
b AS ({_bins('tp', 'temperature, ')} FROM q GROUP BY ALL) SELECT temperature, round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM b GROUP BY 1 ORDER BY 2, 1 LIMIT 1""")
def a18_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ev.tempered(scored(spark, sf_dir), "p", [2, 4, 6, 8, 10, 12])
    return ev.ece(ev.reliability(t, "tempered", "y", ["temperature"]), ["temperature"]).orderBy("ece", "temperature").limit(1)


@REG.query(_EV + _CUM + """, t AS (SELECT pos, (tp - cp + pos) / nullif(tp - cp + pos + tn - cn + neg, 0) AS here, coalesce((tp - cp) / nullif(tp - cp + tn - cn, 0), 1) AS above, tp FROM c)
SELECT round(sum(pos / tp * (here + above) / 2), 6) AS pr_auc FROM t""")
def a19_pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.pr_auc(scored(spark, sf_dir), "s", "y")


_FEATURES = ("s", "integrity_score", "file_size", "width")


@REG.query(_EV + "".join(f"{' UNION ALL' if i else ' '} SELECT '{f}' AS feature, round(coalesce(CASE WHEN isnan(corr({f}, y)) THEN 0 ELSE corr({f}, y) END, 0), 6) AS r FROM ev" for i, f in enumerate(_FEATURES)))
def a20_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda f: F.round(F.coalesce(F.nanvl(F.corr(F.col(f).cast("double"), F.col("y").cast("double")), F.lit(0.0)), F.lit(0.0)), 6)
    one = scored(spark, sf_dir).agg(F.array(*[F.struct(F.lit(f).alias("feature"), r(f).alias("r")) for f in _FEATURES]).alias("x"))
    return one.select(F.inline("x"))


@REG.query(_EV + "".join(f"{' UNION ALL' if i else ' '} SELECT '{f}' AS feature, count(DISTINCT {f}) AS n_distinct, count_if({f} IS NULL)::BIGINT AS n_null, round(avg({f}) FILTER (y = 1), 4) AS mean_1, round(avg({f}) FILTER (y = 0), 4) AS mean_0 FROM ev" for i, f in enumerate(_FEATURES)))
def a21_feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda f, y: F.round(F.avg(F.when(F.col("y") == y, F.col(f))), 4)
    one = scored(spark, sf_dir).agg(F.array(*[F.struct(F.lit(f).alias("feature"), F.count_distinct(f).alias("n_distinct"), F.count_if(F.col(f).isNull()).alias("n_null"), mean(f, 1).alias("mean_1"), mean(f, 0).alias("mean_0")) for f in _FEATURES]).alias("x"))
    return one.select(F.inline("x"))


@REG.query(_EV + """, l AS (SELECT y, unnest([{'f': 's', 'v': s::DOUBLE}, {'f': 'integrity_score', 'v': integrity_score::DOUBLE}]) AS u FROM ev), b AS (SELECT u.f AS feature, u.v AS v, sum(y) AS pos, sum(1 - y) AS neg FROM l WHERE u.v IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY feature) AS p, sum(neg) OVER (PARTITION BY feature) AS n FROM b WINDOW w AS (PARTITION BY feature ORDER BY v))
SELECT feature, round(max(greatest(cn + p - cp, cp + n - cn, p, n) / (p + n)::DOUBLE), 6) AS best_accuracy,
coalesce(max(v) FILTER (pos > 0) < min(v) FILTER (neg > 0) OR max(v) FILTER (neg > 0) < min(v) FILTER (pos > 0), TRUE) AS disjoint FROM c GROUP BY 1""")
def a22_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.separators(scored(spark, sf_dir), ["s", "integrity_score"], "y")


@REG.query(_EV + """, c AS (SELECT g AS category, count(*) AS n, count_if((p >= 0.5)::INT = y) AS ok FROM ev GROUP BY 1) SELECT category, n, round(ok / n::DOUBLE, 4) AS accuracy FROM c UNION ALL SELECT 'overall', sum(n)::BIGINT, round(sum(ok) / sum(n)::DOUBLE, 4) FROM c""")
def a31_category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category and, weighted by size, overall; rows without a score count as wrong."""
    c = scored(spark, sf_dir).groupBy(F.col("g").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("p") >= 0.5).cast("int") == F.col("y")).alias("ok"))
    every = c.agg(F.lit("overall").alias("category"), F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    return c.unionByName(every).select("category", "n", F.round(F.col("ok") / F.col("n"), 4).alias("accuracy"))


@REG.query(_EV + " SELECT g AS category, round(avg(s), 6) AS mean_score, CASE WHEN avg(s) > 50 THEN 'FAILED' ELSE 'PASSED' END AS verdict FROM ev GROUP BY 1")
def a32_audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy(F.col("g").alias("category")).agg(F.round(F.avg("s"), 6).alias("mean_score"), F.when(F.avg("s") > 50, "FAILED").otherwise("PASSED").alias("verdict"))


@REG.query(_EV + """, m AS (SELECT unnest([30, 40, 50]) AS t), a AS (SELECT t, g, avg(((s > t)::INT = y)::INT) AS acc FROM ev, m WHERE s IS NOT NULL GROUP BY ALL), r AS (SELECT t AS model, avg(acc) AS mean_accuracy FROM a GROUP BY 1)
SELECT model, round(mean_accuracy, 6) AS mean_accuracy FROM r ORDER BY round(mean_accuracy, 9) DESC, model LIMIT 1""")
def a33_model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three cut-offs as models, the one of greatest mean accuracy over the categories; the first of equals."""
    d = scored(spark, sf_dir).where("s is not null").select("s", "y", "g", F.explode(F.array(*map(F.lit, (30, 40, 50)))).alias("model"))
    acc = d.groupBy("model", "g").agg(F.avg(((F.col("s") > F.col("model")).cast("int") == F.col("y")).cast("int")).alias("acc"))
    m = acc.groupBy("model").agg(F.avg("acc").alias("a")).orderBy(F.desc(F.round("a", 9)), "model").limit(1)
    return m.select("model", F.round("a", 6).alias("mean_accuracy"))


@REG.query()
def a34_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest on numeric features: importance of each and accuracy on held-out rows (not bit-equal to other libraries)."""
    from provenix.operators.forest import train_and_rate

    d = scored(spark, sf_dir).fillna(0, ["s", "integrity_score", "file_size", "width"])
    return train_and_rate(d, ["s", "integrity_score", "file_size", "width"], "y")


@REG.query(_EV + """, t AS (SELECT id, y, s, row_number() OVER (PARTITION BY y ORDER BY CASE WHEN y = 0 THEN -s ELSE s END, id) AS rn FROM ev WHERE s IS NOT NULL AND (s > 35)::INT <> y) SELECT id, y, s FROM t WHERE rn <= 10""")
def o12_top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten false positives of highest and ten false negatives of lowest score; ties by id."""
    wrong = scored(spark, sf_dir).where("s is not null and cast(s > 35 as int) <> y").select("id", "y", "s")
    return wrong.where("y = 0").orderBy(F.desc("s"), "id").limit(10).unionByName(wrong.where("y = 1").orderBy("s", "id").limit(10))
