"""Same or near-same records across splits: permuted code blocks joined across splits within a Hamming radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenix.llm import hamming
from provenix.operators.skew import salted_pairs
from provenix.session import cut
from provenix.sources.tables import once_by_id

#: Bits in which two fingerprints may differ.
RADIUS = 6


def split_of(split: str = "split", path: str = "filepath") -> Column:
    """train, val, test or null. Letter case and blanks do not count.

    A null split is told by the folder after the data set's: names that begin with train, val or test. Every other
    split, also a blank one, gives null.
    """
    said = F.lower(F.regexp_replace(F.col(split), r"\s+", ""))
    folder = F.lower(F.trim(F.regexp_extract(F.col(path), r"^[^/]*/[^/]*/([^/]*)/", 1)))
    guess = F.when(folder.startswith("train"), "train").when(folder.startswith("val"), "val").when(folder.startswith("test"), "test")
    return F.when(F.col(split).isNull(), guess).when(said.isin("train", "val", "test"), said)


def name_key(filename: str) -> Column:
    """The name a file had before it was renamed; null or empty names give null.

    Extensions, letter case, surrounding blanks and the kind of separator do not count; leading ``copy of`` and
    ``thumb`` and trailing ``copy``, ``edited``, ``resized``, ``(2)``, ``512px``, ``q90`` and ``src_X`` are taken off,
    also several of them.
    """
    s = F.lower(F.trim(F.regexp_replace(F.col(filename), "%20", " ")))
    s = F.regexp_replace(s, r"(\s*\.(jpe?g|png|webp|gif|tiff?|bmp|bak))+$", "")
    s = F.regexp_replace(F.trim(s), r"[\s_\-]+", "_")
    s = F.regexp_replace(s, r"^((copy_of|thumb)_)+", "")
    s = F.regexp_replace(s, r"(_(copy|edited|resized|\(\d+\)|\d+px|q\d+|src_[a-z]+))+$", "")
    return F.when(s != "", s)


def prepare(audit: DataFrame) -> DataFrame:
    """One row per audit_id of the train, val and test splits, with what is compared."""
    one = once_by_id(audit, "audit_id", "filepath", "filename", "split", "sha256", "phash", "width", "height", "source")
    sha = F.lower(F.trim(F.col("sha256")))
    return one.select(
        "audit_id", split_of().alias("part"), F.lower(F.regexp_replace(F.trim(F.col("source")), "-", "_")).alias("source"),
        F.when(sha != "", sha).alias("sha"), hamming.code("phash").alias("p"), name_key("filename").alias("name"), "width", "height",
    ).where(F.col("part").isNotNull())


def overlaps(audit: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of a train record and a val or test record that are the same or nearly so.

    Result: train_id, eval_id, same_sha, dist (bits, null without two usable hashes), same_name; each pair once. A pair
    qualifies by equal sha256, by fingerprints within ``radius`` bits, or, where a fingerprint is missing, by equal
    width, height and name before renaming. Repeated rows count once; null or blank hashes, sizes and names match
    nothing. Only existing pairs are formed: equal fingerprints are joined as classes first.
    """
    rows = cut(prepare(audit))
    train, eval_ = rows.where("part = 'train'"), rows.where("part <> 'train'")
    kind = lambda df, who: df.select(F.col("audit_id").alias(who), "sha", "p", "name", "width", "height")
    t, e = kind(train, "train_id"), kind(eval_, "eval_id")

    by_sha = salted_pairs(t.select("train_id", "sha").where("sha is not null"), e.select("eval_id", "sha").where("sha is not null"), "sha")

    side = F.max(F.when(F.col("part") == "train", 1).otherwise(0)) + F.max(F.when(F.col("part") != "train", 2).otherwise(0))
    classes = rows.where("p is not null").groupBy("p").agg(side.cast("int").alias("side")).withColumn("d", F.lit(0).cast("bigint"))
    classes = cut(classes)
    r = hamming.matching_blocks(classes.count(), radius)
    near = hamming.close_pairs(hamming.with_keys(classes, radius, r), radius, r).select("p_a", "p_b", "dist_p")
    same = classes.where("side = 3").select(F.col("p").alias("p_a"), F.col("p").alias("p_b"), F.lit(0).alias("dist_p"))
    near = cut(near)
    both = near.unionByName(near.select(F.col("p_b").alias("p_a"), F.col("p_a").alias("p_b"), "dist_p")).unionByName(same)
    half = salted_pairs(t.where("p is not null").select("train_id", F.col("p").alias("p_a")), both, "p_a").select("train_id", F.col("p_b").alias("p"), "dist_p")
    by_code = salted_pairs(half, e.where("p is not null").select("eval_id", "p"), "p").select("train_id", "eval_id", F.col("dist_p").alias("dist"))

    named = lambda df, who: df.where("name is not null and width is not null and height is not null").select(
        who, F.struct("name", "width", "height").alias("k"), F.col("p").isNull().alias(f"bare_{who}"))
    by_name = salted_pairs(named(t, "train_id"), named(e, "eval_id"), "k", condition=F.col("bare_train_id") | F.col("bare_eval_id"))

    pair = ["train_id", "eval_id"]
    false, none = F.lit(False), F.lit(None).cast("int")
    found = by_sha.select(*pair, F.lit(True).alias("same_sha"), none.alias("dist"), false.alias("same_name"))
    found = found.unionByName(by_code.select(*pair, false.alias("same_sha"), "dist", false.alias("same_name")))
    found = found.unionByName(by_name.select(*pair, false.alias("same_sha"), none.alias("dist"), F.lit(True).alias("same_name")))
    return found.groupBy(*pair).agg(F.max("same_sha").alias("same_sha"), F.min("dist").alias("dist"), F.max("same_name").alias("same_name"))


def overlap_report(audit: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per split and source of the evaluation record: its records, those that overlap, and the pairs by kind."""
    rows = prepare(audit).where("part <> 'train'").select(F.col("audit_id").alias("eval_id"), F.col("part").alias("split"), "source")
    per = overlaps(audit, radius).groupBy("eval_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("same_sha")).alias("sha"), F.count_if(F.col("dist").isNotNull()).alias("near"), F.count_if(F.col("same_name")).alias("name"))
    full = rows.join(per, "eval_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}")
    return full.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_records"), F.count("pairs").alias("n_overlapping"), total("pairs"), total("sha"), total("near"), total("name"))
