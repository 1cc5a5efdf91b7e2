"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.llm import clusters, components, garble, linkage, mixing, neighbours, overlap, packing, sql
from provenix.plans.registry import Registry
from provenix.sources.tables import table

REG = Registry()


# ---- problem 1 ----
@REG.query(sql.P1)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.overlaps(table(spark, sf_dir, "dataset_audit"))
    return found.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


@REG.query(sql.P1_REPORT)
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "dataset_audit"))


# ---- problem 7 ----
@REG.query(sql.P7)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.media_groups(table(spark, sf_dir, "media_items"), table(spark, sf_dir, "media_relationships"))


@REG.query(sql.P7_REPORT)
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.group_report(table(spark, sf_dir, "media_items"), table(spark, sf_dir, "media_relationships"))


# ---- problem 6 ----
@REG.query(sql.P6)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.neighbours(table(spark, sf_dir, "media_items"))
    return near.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()


# ---- problem 3 ----
@REG.query(sql.P3)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(table(spark, sf_dir, "media_items"))


@REG.query()
def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_report(table(spark, sf_dir, "media_items"))


# ---- problem 4 ----
@REG.query(sql.P4)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.run_deliveries(table(spark, sf_dir, "media_items")).links().select("id_a", "id_b")


@REG.query()
def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = linkage.run_deliveries(table(spark, sf_dir, "media_items")).links()
    return linkage.score(links, linkage.weights(linkage.agreements(links)))


@REG.query()
def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    linker = linkage.run_deliveries(table(spark, sf_dir, "media_items"))
    for k in range(linker.deliveries):
        linker.update_clusters(k)
    return linker.clusters()


# ---- problem 8 ----
@REG.query()
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


@REG.query()
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_report(packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits")))


# ---- problem 9 ----
@REG.query()
def p9_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@REG.query()
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


# ---- problem 10 ----
@REG.query()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.repairs(table(spark, sf_dir, "documents")).select("doc_id")


@REG.query()
def p10_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.repairs(table(spark, sf_dir, "documents"))
