"""Mixing sources to target shares of the total size by Efraimidis-Spirakis sampling.

Every document draws an exponential key, slower for documents of less quality. Where a source must give more than it has,
complete epochs of all its documents come first; the rest of its budget is taken in order of the keys until the tokens
are used up. Where a budget ends is narrowed down by quantiles of a source's keys and the tokens between them, again and
again, until few rows are left to sort, whatever share of the rows one source holds and however its weights lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenix.llm import tokens
from provenix.session import cut

#: Parts into which the keys of a source are cut at a time, and the rows from which that goes on.
PARTS, EDGE_ROWS = 64, 100_000
#: Least quality weight of a document.
LEAST_WEIGHT = 0.05
#: Sources with a target: the table of targets is broadcast only up to this size.
MOST_SOURCES = 10_000


def source_key(column: str) -> Column:
    """A source however it is spelt: letter case, surrounding blanks and ``-`` for ``_`` do not count."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), "-", "_")


def weighed(documents: DataFrame, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, weight) of the documents with at least one token and a source.

    The quality weight is the share of letters and blanks in the text, reduced for texts of fewer than 32 tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            n = np.array([len(tokens.token_ids(t, tokenizer)) for t in texts], "i8")
            good = np.array([sum(map(str.isalpha, t)) + t.count(" ") for t in texts], "f8") / np.maximum([len(t) for t in texts], 1)
            w = np.maximum(LEAST_WEIGHT, good * np.minimum(1.0, n / 32))
            keep = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(n).filter(keep), pa.array(np.round(w, 6)).filter(keep)], ["doc_id", "source", "n_tokens", "weight"])

    rows = documents.where("doc_id is not null and source is not null and text is not null and text <> ''").select("doc_id", source_key("source").alias("source"), "text")
    return rows.mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, weight double")


def exponential_key(seed: int) -> Column:
    """-ln(u) / weight with u from a hash of the document: the same in every run, smaller keys come first."""
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / F.col("weight")


def wanted(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets by source with the available tokens; spellings of one source are one target."""
    want = targets.where("source is not null").select(source_key("source").alias("source"), "target_share", "max_repeat")
    want = want.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    p = want.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    return p.withColumn("_share", share).withColumn("most", F.col("available") * F.greatest(F.coalesce("max_repeat", F.lit(1)), F.lit(0)))


def reachable_total(want: DataFrame) -> int:
    """The largest total at which every source that can give anything reaches its share."""
    least = want.where("most > 0 and _share > 0").agg(F.min(F.floor(F.col("most") / F.col("_share")))).first()[0]
    return int(least or 0)


def plan(want: DataFrame, total_tokens: int) -> DataFrame:
    """Per target: budget (share of ``total_tokens``), tokens that can be given, whole epochs and the rest."""
    p = want.withColumn("budget", F.floor(F.col("_share") * total_tokens).cast("bigint")).withColumn("give", F.least("budget", "most"))
    return p.withColumn("epochs", F.when(F.col("available") > 0, F.expr("give div available")).otherwise(0).cast("int")).withColumn("rest", F.col("give") - F.col("epochs") * F.col("available"))


def cut_points(keyed: DataFrame, share=lambda df: df) -> DataFrame:
    """(source, low, high, before): the budget ``rest`` of a source ends in its keys above ``low`` up to ``high``, and the keys up to ``low`` have ``before`` tokens.

    At most EDGE_ROWS rows of a source lie between, unless more have one and the same key. ``share`` may broadcast.
    """
    points = cut(keyed.select("source", "rest").distinct().select("source", "rest", F.lit(-1.0).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("bigint").alias("before")))
    left = None
    while True:
        inside = keyed.drop("rest").join(share(points), "source").where((F.col("key") > F.col("low")) & (F.col("key") <= F.col("high")))
        most = inside.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= EDGE_ROWS or most == left:
            return points
        left = most
        edges = inside.groupBy("source").agg(F.percentile_approx("key", [k / PARTS for k in range(1, PARTS)], 10_000).alias("edges"))
        part = inside.join(share(cut(edges)), "source").withColumn("part", F.size(F.filter("edges", lambda e: e < F.col("key"))))
        per = part.groupBy("source", "part").agg(F.sum("n_tokens").alias("t"), F.max("key").alias("top"))  # at most PARTS rows to a source
        way = Window.partitionBy("source").orderBy("part")
        per = per.withColumns({"upto": F.sum("t").over(way), "under": F.lag("top").over(way)}).join(share(points), "source")
        first = per.where(F.col("before") + F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min_by(F.struct("under", "top", (F.col("upto") - F.col("t")).alias("t")), "part").alias("p"))
        new = points.join(share(first), "source", "left")
        found = F.col("p").isNotNull()
        points = cut(new.select("source", "rest", F.coalesce("p.under", "low").alias("low"), F.when(found, F.col("p.top")).otherwise(F.col("high")).alias("high"), (F.col("before") + F.coalesce("p.t", F.lit(0))).alias("before")))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 29, tokenizer: str = tokens.TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen documents, report per source).

    Chosen: doc_id, source, n_tokens, uses (complete epochs, plus one if drawn for the rest). Report: source,
    target_share, max_repeat, available, budget, tokens, documents, actual_share of all chosen tokens, reachable (whether
    max_repeat times the available tokens reach the budget). Tokens differ from the smaller of budget and that by less than
    a document. ``total_tokens`` defaults to the largest total at which every source with documents reaches its share;
    with a larger one, sources that run out give all they may and the others' actual shares rise.
    Sources without documents get nothing and are reported; documents without a target, a source or tokens are never
    chosen; a max_repeat of null counts as one.
    """
    rows = cut(weighed(documents, tokenizer))
    sizes = rows.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("documents_available"))
    want = cut(wanted(sizes, targets))
    plans = cut(plan(want, reachable_total(want) if total_tokens is None else total_tokens))
    few = plans.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    share = lambda df: F.broadcast(df) if few else df

    part = plans.select("source", "epochs", "rest")
    keyed = rows.join(share(part), "source").withColumn("key", exponential_key(seed))
    points = cut_points(keyed, share).drop("rest")
    marked = keyed.join(share(points), "source")
    in_order = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = marked.where((F.col("key") > F.col("low")) & (F.col("key") <= F.col("high"))).withColumn("sum", F.sum("n_tokens").over(in_order) + F.col("before"))
    # The document in which the budget ends is taken if that comes closer to the budget than leaving it.
    last = last.withColumn("drawn", (F.col("sum") * 2 - F.col("n_tokens") < F.col("rest") * 2).cast("int")).drop("sum")
    other = marked.where((F.col("key") <= F.col("low")) | (F.col("key") > F.col("high"))).withColumn("drawn", (F.col("key") <= F.col("low")).cast("int"))
    both = other.unionByName(last).withColumn("uses", F.col("epochs") + F.col("drawn")).where("uses > 0")
    chosen = cut(both.select("doc_id", "source", "n_tokens", "uses"))

    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"))
    total = chosen.agg(F.sum(F.col("n_tokens") * F.col("uses"))).first()[0]
    report = plans.join(got, "source", "left").select(
        "source", "target_share", "max_repeat", "available", "budget", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.round(F.coalesce(F.col("tokens") / F.lit(total or 1), F.lit(0.0)), 6).alias("actual_share"), (F.col("give") >= F.col("budget")).alias("reachable"))
    return chosen, report
