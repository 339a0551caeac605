"""The registered queries of the operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, new_scratch_dir
from . import (
    conversations, decontam, html, langid, lines, mixing, neardup, oracle, phrases, quality, secrets, sharding, tokens, urls,
)
from .common import table


def op1_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository, its source for the owner."""
    docs = table(configure(spark), sf_dir, "documents")
    found = secrets.secrets(docs, repository=F.col("doc_id"), owner=F.col("source"))

    def places(keep) -> Column:
        kept = F.filter("findings", keep)
        return F.array_join(F.transform(kept, lambda f: F.concat_ws(":", f["kind"], f["start"], f["stop"])), ",")

    def number(field: str, value: str) -> Column:
        return F.size(F.filter("findings", lambda f: f[field] == value)).cast("long").alias(f"n_{value}")

    return found.select(
        "doc_id", *(number("kind", kind) for kind in secrets.KINDS[:3]),
        F.sha2(places(lambda f: f["kind"] != "opaque"), 256).alias("base_sha256"),
        places(lambda f: F.lit(True)).alias("spans"),
        number("verdict", "live"), number("verdict", "example"),
    )


def op2_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated_lines(table(configure(spark), sf_dir, "documents"))
    return found.select(
        "doc_id", F.md5("line").alias("line_md5"), "n_copies", "n_links", F.md5("class_line").alias("class_md5"), "kept"
    )


def op3_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    profiles = langid.prototypes(docs.where(~F.col("held_out")))
    found = langid.identified(docs.select("doc_id", "held_out", "text"), profiles)
    return found.select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op4_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(configure(spark), sf_dir, "documents"), shingle=4)


def op5_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that a rule decides are the labelled ones."""
    pages = table(configure(spark), sf_dir, "pages")
    return urls.judged(pages, urls.fit(urls.rule_labels(pages))).withColumn("score", F.round("score", 6))


def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(configure(spark), sf_dir, t) for t in ("documents", "benchmark"))
    return decontam.marked(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"), F.col("_longest").alias("longest_match"),
    )


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by the first map, and those after the map was edited for one shard more."""
    docs = table(configure(spark), sf_dir, "documents")
    path = new_scratch_dir(spark, "slot-map")
    placed = sharding.placed_records(docs, 40, map_path=path)
    edited = sharding.rebalance(docs, path, 41).select(F.col("slot").alias("virtual_slot"), F.col("shard").alias("edited_shard"))
    return placed.join(F.broadcast(edited), "virtual_slot", "left").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "edited_shard",
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(configure(spark), sf_dir, "documents"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda acc, d: acc + d["words"])
    places = F.transform("draws", lambda d: F.concat_ws(":", d["shard"], d["order"], d["words"]))
    return rows.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_join(places, ",").alias("draws")
    )


def op9_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(configure(spark), sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(configure(spark), sf_dir, t) for t in ("documents", "labels"))
    return quality.judge_quality(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("llr", 6).alias("llr"),
    )


def op11_survivor_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, times = conversations.damaged(table(configure(spark), sf_dir, "conversations"))
    return conversations.repair_report(rows, copies=times)


def op12_tiled_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(configure(spark), sf_dir, "documents"))


def op13_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(configure(spark), sf_dir, "pages").select("page_id", "url", "html")
    return html.main_texts(pages).select("page_id", "url", F.col("_text").alias("text"), F.col("_n_chars").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_ownership, op2_edit_join, op3_hyperdimensional, op4_odd_sketches, op5_boosted_trees,
        op6_suffix_arrays, op7_virtual_slots, op8_mixing, op9_trie_tokens, op10_quality,
        op11_survivor_viterbi, op12_tiled_phrases, op13_line_blocks,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_odd_sketches": oracle.OP4, "op6_suffix_arrays": oracle.OP6, "op11_survivor_viterbi": oracle.OP11,
        "op12_tiled_phrases": oracle.OP12,
    }
