"""Deduplicating new batches against all history by incremental record linkage.

A store in the shared folder keeps, per delivery, the accepted records, the blocking keys of their fingerprint classes,
the pairs of classes and the links found, the counts of agreement from which field weights are learned, and the changes
of cluster representatives. A delivery probes the stored keys with its own. Of the history it scans columns of keys, ids,
codes and digests, semi-joined with what the delivery asks for before anything is shuffled: the joined side is a written
table whose size Spark knows, so a small delivery is broadcast and what is shuffled follows the delivery and its hits, not
the history. Earlier records are not normalised, keyed or compared with one another again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.llm import hamming
from provenix.llm.components import components
from provenix.operators import skew
from provenix.operators.skew import salted_lookup, salted_pairs
from provenix.session import cut, shared_table
from provenix.sources.tables import once_by_id

#: Bits in which phash and dhash of a near-duplicate may each differ.
RADIUS = 6
#: Upper ends of the levels of agreement of a fingerprint, in bits.
LEVELS = (0, 2, 4, 6)

_ITEM = "id bigint, batch_id int, sha string, p bigint, d bigint"
_PAIR = "p_a bigint, d_a bigint, p_b bigint, d_b bigint, dist_p int, dist_d int"
_AGREEMENT, _REP = "s boolean, p int, d int, n bigint", "old bigint, rep bigint"
_LINK = "id_a bigint, id_b bigint, batch_a int, batch_b int, same_sha boolean, dist_p int, dist_d int"


def normalise(items: DataFrame) -> DataFrame:
    """One row per id: id, batch_id, sha (null if blank), p and d (null unless phash and dhash are both usable)."""
    one = once_by_id(items, "id", "batch_id", "sha256", "phash", "dhash")
    sha = F.lower(F.trim(F.col("sha256")))
    both = hamming.usable("phash") & hamming.usable("dhash")
    return one.select("id", F.col("batch_id").cast("int").alias("batch_id"), F.when(sha != "", sha).alias("sha"), F.when(both, hamming.code("phash")).alias("p"), F.when(both, hamming.code("dhash")).alias("d"))


class Linker:
    """Accepts deliveries and finds the links of each to everything accepted before and within itself."""

    def __init__(self, spark: SparkSession, folder: str | None = None, radius: int = RADIUS, blocks: int | None = None) -> None:
        self.spark, self.radius = spark, radius
        self.folder = folder or shared_table(spark, "linkage")
        self.blocks = blocks
        self.deliveries = 0

    def _path(self, name: str, delivery: int) -> str:
        return f"{self.folder}/{name}/delivery-{delivery}"

    def _read(self, name: str, upto: int, schema: str) -> DataFrame:
        """A table of the store over the deliveries before ``upto``."""
        paths = [self._path(name, k) for k in range(upto)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, schema: str) -> DataFrame:
        """Write a table of the delivery at hand and read it back, so that its size is known."""
        path = self._path(name, self.deliveries)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def ingest(self, items: DataFrame, expected_rows: int | None = None) -> DataFrame:
        """Accept a delivery; returns its links (id_a < id_b, of different batches, at least one of them new).

        A record whose id is already accepted is the same record again and is left out. Links need an equal non-blank
        sha256, or four usable fingerprints within the radius in phash and in dhash. Null batches link to nothing.
        ``expected_rows`` of the whole store, if known, picks the number of blocks; the links don't depend on it.
        """
        k = self.deliveries
        history = self._read("items", k, _ITEM)
        rows = normalise(items)
        if k:
            rows = self._write(rows, "arrived", _ITEM)
            again = history.select("id").join(rows.select("id"), "id", "left_semi")
            rows = rows.join(again, "id", "left_anti")
        new = self._write(rows, "items", _ITEM)
        n = new.count()
        none_hot = [] if n <= skew.HOT_ROWS else None
        if self.blocks is None:
            self.blocks = hamming.matching_blocks(expected_rows or n, self.radius)
        r = self.blocks

        classes = new.where("p is not null").select("p", "d").distinct()
        keys = "p bigint, d bigint, bucket bigint"
        fresh = self._write(hamming.with_keys(classes, self.radius, r), "keys", keys)
        found = hamming.close_pairs(fresh.withColumn("side", F.lit(3)), self.radius, r, self.radius)
        if k:  # stored keys are streamed past the new ones, which are broadcast if few; they are not shuffled then
            stored = self._read("keys", k, keys).select(F.col("p").alias("p_b"), F.col("d").alias("d_b"), "bucket")
            apart = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
            met = stored.join(fresh.select(F.col("p").alias("p_a"), F.col("d").alias("d_a"), "bucket"), "bucket")
            met = met.where((apart("p") <= self.radius) & (apart("d") <= self.radius) & ((F.col("p_a") != F.col("p_b")) | (F.col("d_a") != F.col("d_b"))))
            found = found.unionByName(met.select("p_a", "d_a", "p_b", "d_b", apart("p").alias("dist_p"), apart("d").alias("dist_d")))
        near = self._write(found, "pairs", _PAIR)
        turned = near.select(F.col("p_b").alias("p_a"), F.col("d_b").alias("d_a"), F.col("p_a").alias("p_b"), F.col("d_a").alias("d_b"), "dist_p", "dist_d")
        same = classes.select(F.col("p").alias("p_a"), F.col("d").alias("d_a"), F.col("p").alias("p_b"), F.col("d").alias("d_b"), F.lit(0).alias("dist_p"), F.lit(0).alias("dist_d"))
        pairs = near.unionByName(turned).unionByName(same)
        if k:
            pairs = pairs.distinct()
        pairs = pairs.select(F.struct("p_a", "d_a").alias("ka"), F.struct("p_b", "d_b").alias("kb"), "dist_p", "dist_d")

        mine = new.where("batch_id is not null")
        coded, hashed = mine.where("p is not null"), mine.where("sha is not null")
        old = history.where("batch_id is not null")
        if k:  # of the history, only records of classes and digests that were hit
            met = near.select(F.col("p_b").alias("p"), F.col("d_b").alias("d")).unionByName(new.where("p is not null").select("p", "d"))
            every_coded = coded.unionByName(old.where("p is not null").join(met, ["p", "d"], "left_semi").select(coded.columns))
            every_hashed = hashed.unionByName(old.where("sha is not null").join(new.select("sha"), "sha", "left_semi").select(hashed.columns))
        else:
            every_coded, every_hashed = coded, hashed
        half = cut(salted_pairs(coded.select(F.col("id").alias("x"), F.col("batch_id").alias("bx"), F.struct(F.col("p").alias("p_a"), F.col("d").alias("d_a")).alias("ka")), pairs, "ka", hot=none_hot).drop("ka"))
        few = [] if half.count() <= skew.HOT_ROWS else None
        other = every_coded.select(F.col("id").alias("y"), F.col("batch_id").alias("b_y"), F.struct(F.col("p").alias("p_b"), F.col("d").alias("d_b")).alias("kb"))
        by_code = salted_pairs(half, other, "kb", condition=F.col("bx") != F.col("b_y"), hot=few).select("x", "y", "bx", "b_y", F.lit(False).alias("same_sha"), "dist_p", "dist_d")
        sha = salted_pairs(hashed.select(F.col("id").alias("x"), F.col("batch_id").alias("bx"), "sha"),
                           every_hashed.select(F.col("id").alias("y"), F.col("batch_id").alias("b_y"), "sha"), "sha", condition=F.col("bx") != F.col("b_y"), hot=none_hot)
        none = F.lit(None).cast("int")
        by_sha = sha.select("x", "y", "bx", "b_y", F.lit(True).alias("same_sha"), none.alias("dist_p"), none.alias("dist_d"))
        both = by_code.unionByName(by_sha)
        lo = F.col("x") < F.col("y")
        ends = both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.when(lo, F.col("bx")).otherwise(F.col("b_y")).alias("batch_a"),
                           F.when(lo, F.col("b_y")).otherwise(F.col("bx")).alias("batch_b"), "same_sha", "dist_p", "dist_d")
        links = ends.groupBy("id_a", "id_b").agg(F.first("batch_a").alias("batch_a"), F.first("batch_b").alias("batch_b"), F.max("same_sha").alias("same_sha"), F.min("dist_p").alias("dist_p"), F.min("dist_d").alias("dist_d"))
        out = self._write(links, "links", _LINK)
        self.deliveries += 1
        return out

    def links(self) -> DataFrame:
        """All links found so far."""
        return self._read("links", self.deliveries, _LINK)

    def learn(self, delivery: int) -> dict[str, list[float]]:
        """Count the agreements of a delivery's links into the store (at most 50 rows) and give the weights of all so far."""
        agreements(self._read_one("links", delivery, _LINK)).coalesce(1).write.mode("overwrite").parquet(self._path("agreements", delivery))
        return weights(self._read("agreements", delivery + 1, _AGREEMENT))

    def _read_one(self, name: str, delivery: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(name, delivery))

    def update_clusters(self, delivery: int, least: float = 0.0) -> DataFrame:
        """Union the clusters that a delivery's links join; (old, rep) of the representatives that changed.

        A link counts if its weight, learned from all links up to this delivery, is above ``least``. Only ends of such
        links are looked up, so clusters without a new link are not touched. The representative is the smallest id of
        the cluster. Deliveries are to be given in order.
        """
        w = self.learn(delivery)
        ends = cut(score(self._read_one("links", delivery, _LINK), w).where(F.col("weight") > least).select("id_a", "id_b"))
        for end in ("id_a", "id_b"):
            ends = self._now(ends, end, delivery)
        moved = components(ends).where("node <> group_id").select(F.col("node").alias("old"), F.col("group_id").alias("rep"))
        moved.write.mode("overwrite").parquet(self._path("reps", delivery))
        return self._read_one("reps", delivery, _REP)

    def _now(self, df: DataFrame, column: str, upto: int) -> DataFrame:
        """``column`` replaced by its representative after ``upto`` deliveries.

        Who has been replaced stays so, hence an id is ``old`` in one delivery at most: all changes are one forest, which
        is walked up in as many joins as its longest path has steps, not as there are deliveries.
        """
        if not upto:
            return df
        change = self._read("reps", upto, _REP).withColumnRenamed("old", column)
        while True:
            step = cut(salted_lookup(df, change, column))
            df = step.withColumn(column, F.coalesce("rep", column)).drop("rep")
            if not step.where("rep is not null").limit(1).count():
                return df

    def clusters(self) -> DataFrame:
        """(media_id, cluster_rep) of every accepted record; unlinked records represent themselves."""
        rows = self._read("items", self.deliveries, "id bigint").select(F.col("id").alias("media_id"))
        root = components(self._read("reps", self.deliveries, _REP)).select(F.col("node").alias("media_id"), "group_id")
        return salted_lookup(rows, root, "media_id", hot=[]).select("media_id", F.coalesce("group_id", "media_id").alias("cluster_rep"))


def _level(column: str) -> F.Column:
    return F.coalesce(*[F.when(F.col(column) <= top, i) for i, top in enumerate(LEVELS)], F.lit(len(LEVELS)))


def agreements(links: DataFrame) -> DataFrame:
    """(s, p, d, n): how many links have each pattern of agreement; at most 50 rows."""
    return links.groupBy(F.col("same_sha").alias("s"), _level("dist_p").alias("p"), _level("dist_d").alias("d")).agg(F.count(F.lit(1)).alias("n"))


def weights(counted: DataFrame) -> dict[str, list[float]]:
    """Log2 likelihood ratio of each level of agreement of sha, p and d, from patterns as of :func:`agreements`.

    How often linked pairs reach a level is counted over all links (at most 50 patterns come to the driver) and smoothed;
    how often unrelated pairs do follows from 64 independent even bits.
    """
    rows = counted.groupBy("s", "p", "d").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in rows)
    chance, below = [], 0.0
    for top in LEVELS:
        reach = sum(math.comb(64, i) for i in range(top + 1)) / 2**64
        chance.append(reach - below)
        below = reach
    chance.append(1 - below)
    out = {"s": []}
    for value, u in ((False, 1 - 2**-60), (True, 2**-60)):
        m = (sum(r["n"] for r in rows if r["s"] == value) + 0.5) / (total + 1)
        out["s"].append(math.log2(m / u))
    for f in ("p", "d"):
        out[f] = [math.log2((sum(r["n"] for r in rows if r[f] == i) + 0.5) / (total + 0.5 * len(chance)) / u) for i, u in enumerate(chance)]
    return out


def score(links: DataFrame, w: dict[str, list[float]]) -> DataFrame:
    """Links with ``weight``, the sum of the learned weights of their levels."""
    level = lambda c, f: F.coalesce(*[F.when(F.col(c) <= top, F.lit(w[f][i])) for i, top in enumerate(LEVELS)], F.lit(w[f][-1]))
    return links.withColumn("weight", F.round(F.when(F.col("same_sha"), w["s"][1]).otherwise(w["s"][0]) + level("dist_p", "p") + level("dist_d", "d"), 4))


#: Share of the range of batch numbers that is loaded first; every later batch is a delivery of its own.
FIRST = 0.9


def run_deliveries(items: DataFrame, first: float = FIRST, radius: int = RADIUS) -> Linker:
    """Feed a media table to a new store in order of batch: a first load, then batch by batch; rows without a batch come last."""
    linker = Linker(items.sparkSession, radius=radius)
    n = items.count()
    batches = [r[0] for r in items.select("batch_id").where("batch_id is not null").distinct().orderBy("batch_id").collect()]  # weeks
    upto = batches[0] + round((batches[-1] - batches[0]) * first) if batches else None
    if upto is not None:
        linker.ingest(items.where(F.col("batch_id") <= upto), expected_rows=n)
    for batch in batches:
        if batch > upto:
            linker.ingest(items.where(F.col("batch_id") == batch), expected_rows=n)
    rest = items.where("batch_id is null")
    if not batches or rest.limit(1).count():
        linker.ingest(rest, expected_rows=n)
    return linker
