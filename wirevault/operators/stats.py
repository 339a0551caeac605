"""Archive statistics and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_stats(flows: DataFrame, body_stats: DataFrame) -> DataFrame:
    """One row: flow count, distinct bodies, observations, dedup ratio and byte totals.

    ``unique_bytes`` sums every distinct body once; ``observed_bytes`` sums what would be
    stored without deduplication.
    """
    n_flows = flows.agg(F.count("*").alias("n")).scalar()
    totals = body_stats.agg(
        F.count("*").alias("unique_bodies"),
        F.coalesce(F.sum("seen_count"), F.lit(0)).alias("body_occurrences"),
        F.coalesce(F.sum(F.col("size").cast("bigint")), F.lit(0)).alias("unique_bytes"),
        F.coalesce(F.sum(F.col("size") * F.col("seen_count")), F.lit(0)).alias("observed_bytes"),
    )
    ratio = F.try_divide(F.col("body_occurrences"), F.col("unique_bodies"))
    return totals.select(
        n_flows.alias("flows"),
        "unique_bodies",
        "body_occurrences",
        F.coalesce(F.bround(ratio, 1), F.lit(0.0)).alias("dedup_ratio"),
        "unique_bytes",
        "observed_bytes",
    )


def tech_facets(flows: DataFrame, limit: int | None = 30) -> DataFrame:
    """Flows per tag, most frequent first; flows without tags do not appear."""
    counts = (
        flows.select(F.explode("fingerprints").alias("tech"))
        .groupBy("tech")
        .agg(F.count("*").alias("n"))
    )
    ordered = counts.orderBy(F.col("n").desc(), "tech")
    return ordered if limit is None else ordered.limit(limit)


def top_tech(flows: DataFrame) -> DataFrame:
    """The 15 most frequent tags."""
    return tech_facets(flows, limit=15)


def hosts_by_tech(flows: DataFrame, tech: str | None = None) -> DataFrame:
    """Every host that runs a technology, with its number of flows and last sighting."""
    tagged = flows.select("host", "ts", F.explode("fingerprints").alias("tech"))
    if tech is not None:
        tagged = tagged.where(F.col("tech") == tech)
    return tagged.groupBy("tech", "host").agg(
        F.count("*").alias("n_flows"), F.max("ts").alias("last_seen")
    )


def top_shapes(flow_agg: DataFrame, host: str | Column, k: int = 20) -> DataFrame:
    """The most frequent request shapes of one host."""
    return (
        flow_agg.where(F.col("host") == host)
        .orderBy(F.col("hit_count").desc(), F.col("last_seen").desc(), "shape_sha")
        .limit(k)
    )
