"""Structured Streaming: windowed counts, keyed state and scoring of arriving items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.session import shared_table


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table of a data folder as a stream of its files; works for a Parquet file and for a folder of them."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums per hour and type.

    In ``append`` mode an hour comes out once, when the watermark has passed it, and rows later than that are dropped; in
    ``update`` and ``complete`` mode it comes out as it grows, and in the latter the watermark drops nothing.
    """
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = at.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def run_to_table(stream: DataFrame, mode: str, name: str, folder: str | None = None) -> DataFrame:
    """Run a stream over what is there and return what it wrote.

    ``complete`` keeps the last full result; ``append`` and ``update`` keep every batch, with its number in ``batch``.
    Each batch is written to a folder of its own, so a batch that runs twice after a failure replaces itself. State and
    results lie under ``folder``: given again, the stream goes on where it stopped and each input counts once; without
    one, a fresh folder is taken.
    """
    spark = stream.sparkSession
    home = folder or shared_table(spark, name)
    out, state = f"{home}/out", f"{home}/state"

    def write(df: DataFrame, batch: int) -> None:
        target = out if mode == "complete" else f"{out}/batch={batch}"
        df.write.mode("overwrite").parquet(target)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def case_totals(items: DataFrame) -> DataFrame:
    """Running items and greatest risk of each case as built-in state; a record delivered again counts once.

    The ids seen are state too: they are dropped by the watermark two weeks after a record's ingestion, so a repeat that
    is later than that counts again.
    """
    rows = items.select("id", "case_id", "risk_score", F.coalesce("ingested_at", "created_at", F.lit("1970-01-01")).cast("timestamp").alias("at")).where("id is not null and case_id is not null and risk_score is not null")
    once = rows.withWatermark("at", "14 days").dropDuplicatesWithinWatermark(["id"])
    return once.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_items"), F.max("risk_score").alias("max_risk"))


def latest(updates: DataFrame, key: str, order: str) -> DataFrame:
    """Last update of each key."""
    rest = [c for c in updates.columns if c not in (key, order)]
    return updates.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("u")).select(key, f"u.{order}", *[f"u.{c}" for c in rest])
