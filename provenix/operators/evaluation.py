"""Measures of scored and labelled rows: one pass with map-side sums wherever the measure allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenix.operators.prefix import cumulative

#: Edges between ten equal bins, as floating-point steps of a tenth give them.
EDGES = [i * 0.1 for i in range(1, 10)]


def confusion(predicted: Column, label: Column) -> list[Column]:
    """tp, tn, fp, fn as aggregates; null predictions or labels count nowhere."""
    hit = lambda p, y: F.count_if((predicted == p) & (label == y))
    return [hit(True, 1).alias("tp"), hit(False, 0).alias("tn"), hit(True, 0).alias("fp"), hit(False, 1).alias("fn")]


def rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1, specificity, fpr and fnr from tp, tn, fp, fn; a zero denominator gives 0."""
    c = {k: F.col(k).cast("double") for k in ("tp", "tn", "fp", "fn")}
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = {"accuracy": part(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]), "precision": part(c["tp"], c["tp"] + c["fp"]), "recall": part(c["tp"], c["tp"] + c["fn"]),
           "f1": part(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]), "specificity": part(c["tn"], c["tn"] + c["fp"]), "fpr": part(c["fp"], c["fp"] + c["tn"]), "fnr": part(c["fn"], c["fn"] + c["tp"])}
    return df.select("*", *[F.round(v, 6).alias(k) for k, v in out.items()])


def _by_value(df: DataFrame, score: str, label: str) -> DataFrame:
    one = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return one.groupBy(F.col(score).cast("double").alias("v")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((1 - F.col(label)).cast("bigint")).alias("neg"))


def auc(df: DataFrame, score: str, label: str, one_class: float = 0.0) -> DataFrame:
    """(auc,) by ranks, ties counting half; ``one_class`` if a class is missing or the table is empty."""
    c = cumulative(_by_value(df, score, label), "v", "neg")
    wins = F.sum(F.col("pos") * (F.col("c_neg") - F.col("neg") / 2))
    total = F.sum("pos").cast("double") * F.sum("neg")
    return c.agg(F.round(F.coalesce(F.try_divide(wins, total), F.lit(one_class)), 6).alias("auc"))


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tpr, fpr) for score > threshold at every value, one below the least and one above the greatest."""
    v = _by_value(df, score, label)
    c = cumulative(v, "v", "pos", "neg")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    lo, hi, p, n = ends.first() or (None, None, None, None)
    if lo is None:
        return c.select(F.col("v").alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")).limit(0)
    part = lambda x, t: F.round(x / t, 6) if t else F.lit(0.0)
    inner = c.select(F.col("v").alias("threshold"), part(p - F.col("c_pos"), p).alias("tpr"), part(n - F.col("c_neg"), n).alias("fpr"))
    outer = df.sparkSession.createDataFrame([(lo - 1, 1.0 if p else 0.0, 1.0 if n else 0.0), (hi + 1, 0.0, 0.0)], "threshold double, tpr double, fpr double")
    return inner.unionByName(outer)


def pr_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(pr_auc,): trapezoids under precision over recall, from recall 0 at precision 1; 0 without positives."""
    v = _by_value(df, score, label)
    c = cumulative(v, "v", "pos", "neg")
    p, n = v.agg(F.sum("pos"), F.sum("neg")).first()
    if not p:
        return df.sparkSession.createDataFrame([(0.0,)], "pr_auc double")
    # From the top down: positives and negatives at or above each value.
    tp, fp = F.lit(p) - F.col("c_pos") + F.col("pos"), F.lit(n) - F.col("c_neg") + F.col("neg")
    above_tp, above_fp = F.lit(p) - F.col("c_pos"), F.lit(n) - F.col("c_neg")
    here = F.try_divide(tp.cast("double"), tp + fp)
    above = F.coalesce(F.try_divide(above_tp.cast("double"), above_tp + above_fp), F.lit(1.0))
    return c.agg(F.round(F.sum((tp - above_tp) / F.lit(float(p)) * (here + above) / 2), 6).alias("pr_auc"))


def sweep(df: DataFrame, score: str, label: str, thresholds: list[float], strict: bool = True, by: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn and rates for each threshold, all from one pass; ``strict``: score > t, else score >= t."""
    s = F.col(score)
    at = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *confusion(s > t if strict else s >= t, F.col(label))) for t in thresholds])
    one = df.groupBy(*(by or [])).agg(at.alias("x"))
    return rates(one.select(*(by or []), F.explode("x").alias("x")).select(*(by or []), "x.*"))


def bin_of(p: Column) -> Column:
    """Bin 0 to 9 of a probability by comparison with the edges; 1.0 is in the last."""
    return sum((F.when(p >= e, 1).otherwise(0) for e in EDGES), F.lit(0))


def reliability(df: DataFrame, p: str, label: str, by: list[str] | None = None) -> DataFrame:
    """(bin, n, confidence, accuracy) of the ten bins; empty ones only where ``by`` is not given."""
    keys = by or []
    full = df.where(F.col(p).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, bin_of(F.col(p)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(label).alias("accuracy"))
    if keys:
        return full
    bins = df.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return bins.join(full, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def ece(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error of :func:`reliability` rows; 0 without rows."""
    err = F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")
    return bins.groupBy(*(by or [])).agg(F.round(F.coalesce(err, F.lit(0.0)), 6).alias("ece"))


def tempered(df: DataFrame, p: str, temperatures: list[float]) -> DataFrame:
    """Rows once per temperature, with the probability rescaled through its logit (clipped to 0.01 and 0.99)."""
    q = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col(p)))
    t = F.explode(F.array(*[F.lit(float(x)) for x in temperatures])).alias("temperature")
    return df.select("*", t).withColumn("tempered", 1 / (1 + F.exp(-F.log(q / (1 - q)) / F.col("temperature"))))


def separators(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, best_accuracy, disjoint): accuracy of the best cut of each feature, and whether its ranges don't meet."""
    long = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("f")).select("y", "f.*").where("v is not null")
    by = long.groupBy("feature", "v").agg(F.sum(F.col("y").cast("bigint")).alias("pos"), F.sum((1 - F.col("y")).cast("bigint")).alias("neg"))
    upto = Window.partitionBy("feature").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("feature")
    c = by.select("feature", "v", "pos", "neg", F.sum("pos").over(upto).alias("cp"), F.sum("neg").over(upto).alias("cn"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    above = F.col("cn") + F.col("p") - F.col("cp")
    best = F.max(F.greatest(above, F.col("p") + F.col("n") - above, F.col("p"), F.col("n")) / (F.col("p") + F.col("n")))
    ranges = [F.min(F.when(F.col("pos") > 0, F.col("v"))).alias("p0"), F.max(F.when(F.col("pos") > 0, F.col("v"))).alias("p1"), F.min(F.when(F.col("neg") > 0, F.col("v"))).alias("n0"), F.max(F.when(F.col("neg") > 0, F.col("v"))).alias("n1")]
    g = c.groupBy("feature").agg(F.round(best, 6).alias("best_accuracy"), *ranges)
    return g.select("feature", "best_accuracy", F.coalesce((F.col("p1") < F.col("n0")) | (F.col("n1") < F.col("p0")), F.lit(True)).alias("disjoint"))
