"""The stored archive: Parquet tables that grow by batches.

There is no table format with MERGE here, so nothing is updated in place:

* every batch writes its own directory of each table and a retried batch overwrites
  exactly that directory, which makes a batch idempotent;
* counters are stored as per-batch deltas. All of them are sums, minima, maxima or "value
  at the minimum", so readers fold deltas in any order and `compact` folds them for good;
* a new set of rules writes a new generation of the flows; readers switch when it is complete.

Layout below the root::

    flows/gen=G/batch_id=N/dt=D     one row per kept flow, bodies by key, tags inline
    body_content/batch_id=N         each distinct body once in the whole archive
    body_stats/batch_id=N           counters per body
    body_text/batch_id=N            words of each body ever served as text
    body_words/batch_id=N           the same by word: lists of body keys
    flow_tags/base=G/n=N/dt=D       tags given later to flows that had none, over generation G
    shape_stats/batch_id=N          counters per request shape
    dead_letters/batch_id=N         rejected records
    returned/batch_id=N             ids of records whose writer asked for them
    staging*/batch_id=N             the parsed batch that all of the above read, removed after it
    *_snapshot/n=N, hot_bodies/n=N  folded counters; bodies whose flows joins must split
    registry/kind=K/n=N             one small row per batch, snapshot or generation
"""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import schemas
from .functions.keys import packed_key, unpacked_key
from .operators.bodies import (
    body_stats,
    chosen_content,
    content_in_place,
    content_once,
    distinct_content,
    hot_bodies,
    join_bodies,
    merge_body_stats,
    observations,
    odd_copies,
    text_index,
    with_body_keys,
)
from .operators.joins import BROADCAST_ROWS, lookup
from .operators.postings import DICTIONARY, local_postings
from .operators.rollup import flow_agg, merge_shape_stats, shape_stats
from .operators.tagging import RuleSet, tag_flows
from .session import configure, path_exists, remove_path
from .sources.common import ARRIVAL, dead_letters

_PARQUET = {"compression": "zstd"}
# Fixed value: bodies are written once and kept for good, so they get a high level.
_BODY_PARQUET = {**_PARQUET, "parquet.compression.codec.zstd.level": "10"}
# Staged data is read back at once and never again. It holds bodies, so it is packed like the rest.
_STAGING = (
    "staging", "staging_bodies", "staging_known", "staging_splits", "staging_features", "staging_chosen", "staging_odd", "staging_late",
)


class Archive:
    """Reader and writer of one archive folder, which all executors must be able to reach."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        rules: RuleSet | None = None,
        *,
        strip_markup: bool = False,
        indexed_chars: int | None = None,
        more: StructType | None = None,
    ):
        """``indexed_chars`` bounds the characters of a body that can be searched for; none by default.

        ``more`` names columns that flows of this archive have besides `schemas.STORED_FLOW`: batches
        that bring them keep them, and flows stored before they were known read as null.
        """
        self.spark = configure(spark)
        self.root = root.rstrip("/")
        self.rules = rules or RuleSet()
        self.strip_markup = strip_markup
        self.indexed_chars = indexed_chars
        self.flow_schema = StructType([*schemas.STORED_FLOW.fields, *(more.fields if more else [])])
        self._stored = [f.name for f in self.flow_schema]

    # -- reading ---------------------------------------------------------------------

    def flows(self, *, all_columns: bool = False) -> DataFrame:
        """Stored flows with their current tags, plus ``dt`` for partition pruning.

        ``all_columns`` adds the columns that other writers of the archive stored and this one was not
        told of; it reads the footers of all files for that.
        """
        stored = self._generation(all_columns)
        base = self._latest("flows")[0] or 0
        given = self._registry().where((F.col("kind") == "tags") & (F.col("upto") == base))
        rows = given.agg(F.sum("written").alias("n")).first()["n"]
        if not rows:
            return stored
        later = self._read("flow_tags", schemas.FLOW_TAGS).where(F.col("base") == base)
        days = [r["dt"] for r in later.select("dt").distinct().collect()]  # partition values only
        tags = later.select(F.col("id").alias("_tagged"), F.col("fingerprints").alias("_tags"))
        touched = lookup(stored.where(F.col("dt").isin(days)), tags, "id", table_key="_tagged", table_rows=rows)
        own = F.size("fingerprints") > 0  # a batch that was repeated since has tags of its own
        current = F.when(own, F.col("fingerprints")).otherwise(F.coalesce("_tags", "fingerprints"))
        overlaid = touched.withColumn("fingerprints", current).select(stored.columns)
        return stored.where(~F.col("dt").isin(days) | F.col("dt").isNull()).unionByName(overlaid)

    def _generation(self, all_columns: bool = False) -> DataFrame:
        """Flows with the tags of their files."""
        schema = schemas.extend(self.flow_schema, gen=schemas.LONG, batch_id=schemas.LONG, dt=schemas.DAY)
        if all_columns and path_exists(self.spark, f"{self.root}/flows"):
            found = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/flows").schema
            known = set(schema.names)
            schema = StructType([*schema, *(f for f in found if f.name not in known)])
        stored = self._read("flows", schema)
        gen, upto = self._latest("flows")
        current = F.col("gen") == 0
        if gen is not None:
            tagged_again = (F.col("gen") == gen) & (F.col("batch_id") <= upto)
            current = tagged_again | (current & (F.col("batch_id") > upto))
        return stored.where(current).drop("gen")

    def body_content(self) -> DataFrame:
        """Every distinct body: key, size, content and the text flag of its first observation."""
        stored = self._read("body_content", schemas.extend(schemas.BODY_CONTENT, batch_id=schemas.LONG))
        return stored.select("sha256", "size", "content", "is_text")

    def body_stats(self) -> DataFrame:
        """Counters per distinct body."""
        return merge_body_stats(self._deltas("body_stats", schemas.BODY_STATS))

    def bodies(self) -> DataFrame:
        """The bodies table: key, size, content, text flag, times seen and first seen."""
        counters = self.body_stats().select("sha256", "seen_count", "first_seen")
        return self.body_content().join(counters, "sha256")

    def body_words(self) -> DataFrame:
        """Postings of all words of text bodies, for `match_flows`."""
        return self._read("body_words", schemas.extend(schemas.BODY_WORDS, batch_id=schemas.LONG))

    def body_text(self) -> DataFrame:
        return self._read("body_text", schemas.extend(schemas.BODY_TEXT, batch_id=schemas.LONG)).drop("batch_id")

    def flow_agg(self) -> DataFrame:
        """The roll-up, hits of collapsed flows included."""
        return flow_agg(merge_shape_stats(self._deltas("shape_stats", schemas.SHAPE_STATS)))

    def returned_ids(self, batch_id: int) -> DataFrame:
        """`key, id` of the records of a batch that was stored with ``returning``."""
        schema = schemas.extend(schemas.RETURNED, batch_id=schemas.LONG)
        return self._read("returned", schema).where(F.col("batch_id") == batch_id).drop("batch_id")

    def dead_letters(self) -> DataFrame:
        return self._read("dead_letters", schemas.extend(schemas.DEAD_LETTER, batch_id=schemas.LONG))

    def hot_bodies(self) -> DataFrame:
        """Bodies whose flows are split in joins; a bounded list, see `operators.bodies`.

        The list is refreshed by `compact` and by the first batch. Joins are exact with any
        list, since both sides of a join are split by the same one.
        """
        n, _ = self._latest("hot_bodies")
        if n is None:
            return self.spark.createDataFrame([], schemas.HOT_BODIES)
        return self.spark.read.schema(schemas.HOT_BODIES).parquet(f"{self.root}/hot_bodies/n={n}")

    def counts(self) -> tuple[int, int]:
        """Records written and rejected so far."""
        row = (
            self._registry().where("kind = 'batch'")
            .agg(F.sum("written").alias("w"), F.sum("rejected").alias("r")).first()
        )
        return row["w"] or 0, row["r"] or 0

    # -- writing ---------------------------------------------------------------------

    def ingest(
        self, parsed: DataFrame, *, batch_id: int, source: str = "batch", returning: str | None = None
    ) -> tuple[int, int]:
        """Store one batch of parsed records; returns how many were written and rejected.

        ``parsed`` comes from a source's parse function. Batches are numbered upwards; the
        same number again replaces that batch, as a streaming retry does. Records get ids
        in order of arrival unless they bring their own ``id``. With ``returning``, a column that
        names each record, `returned_ids` tells which id it got.
        """
        self._warn_of_other_rules()
        staged, seen = self._stage(parsed, batch_id, whole={returning, *self._stored})
        base = self._last_id(before=batch_id)
        good = staged.where(F.col("reason").isNull())
        numbered, last_id = self._number(good, base, batch_id)
        good = numbered.withColumn("ingest_seq", F.col("id"))

        stats = self._batch_bodies(good, batch_id)
        known = self._known_bodies(stats, batch_id)
        now = F.lit(dt.datetime.now(dt.timezone.utc))
        rejected = dead_letters(staged, source=source, ingest_ts=now)
        writes = [
            lambda: self._write_flows(good, stats, known, batch_id),
            lambda: self._write_bodies(good, stats, known, batch_id),
            lambda: self._write(shape_stats(good), "shape_stats", batch_id),
            lambda: self._write(rejected, "dead_letters", batch_id),
        ]
        if returning is not None:
            ids = good.select(F.col(returning).cast("string").alias("key"), "id")
            writes.append(lambda: self._write(ids, "returned", batch_id))
        self._together(*writes)
        self._register("batch", batch_id, batch_id, last_id, seen["written"], seen["rejected"])
        if batch_id == 0:
            self._list_hot_bodies(batch_id)
        for table in _STAGING:
            remove_path(self.spark, f"{self.root}/{table}/batch_id={batch_id}")
        return seen["written"], seen["rejected"]

    def _warn_of_other_rules(self) -> None:
        """New flows would lack the tags that the stored ones were given last."""
        entries = self._registry()
        base = self._latest("flows")[0] or 0
        # Tags laid over the newest generation are newer than it.
        for kind in ((F.col("kind") == "tags") & (F.col("upto") == base), F.col("kind") == "flows"):
            last = entries.where(kind).agg(F.max_by("rules", "n").alias("rules")).first()["rules"]
            if last is not None:
                break
        if last is not None and last != self.rules.names():
            warnings.warn(f"stored flows were tagged by {last}, this batch is by {self.rules.names()}", stacklevel=3)

    def _together(self, *writes: Callable[[], object]) -> None:
        """Submit independent jobs at once, so that the tail of one overlaps with the next."""
        with ThreadPoolExecutor(len(writes)) as pool:
            jobs = [pool.submit(inheritable_thread_target(self.spark)(write)) for write in writes]
        for job in jobs:
            job.result()

    def _stage(self, parsed: DataFrame, batch_id: int, *, whole: set[str | None]) -> tuple[DataFrame, dict[str, int]]:
        """Parse once, hash once: all tables of the batch are built from this copy.

        It holds a body once per task and the raw text of rejected records only, since nothing reads
        more of them. Columns in ``whole`` are kept as they are.
        """
        defaults = {
            "src_time": F.lit(None).cast("timestamp"),
            "src_file": F.lit(""),
            "src_split": F.spark_partition_id().cast("bigint"),
            "raw": F.lit(None).cast("string"),
            "reason": F.lit(None).cast("string"),
            "source_tool": F.lit(None).cast("string"),
            "collapse": F.lit(False),
            "replay_of": F.lit(None).cast("bigint"),
        }
        missing = {n: c for n, c in defaults.items() if n not in parsed.columns}
        keyed = with_body_keys(parsed.withColumns(missing)).withColumn("ts", F.col("ts").cast("timestamp"))
        if "src_row" not in keyed.columns:  # lines that were dealt out bring it, see `sources.jsonl.spread_lines`
            keyed = keyed.withColumn("src_row", F.monotonically_increasing_id())
        seen = Observation()
        bad = F.col("reason").isNotNull()
        lean = content_once(keyed, where=~bad, sides=[s for s in ("req", "resp") if f"{s}_body" not in whole])
        if "raw" not in whole:
            lean = lean.withColumn("raw", F.when(bad, F.col("raw")))
        observed = lean.observe(
            seen, F.count_if(~bad).alias("written"), F.count_if(bad).alias("rejected")
        )
        path = self._write(observed, "staging", batch_id)
        return self.spark.read.schema(keyed.schema).parquet(path), seen.get

    def _number(self, staged: DataFrame, base: int, batch_id: int) -> tuple[DataFrame, int]:
        """Give staged records ids above ``base`` in order of arrival; also returns the last id.

        Only the first and last row number of each input split are gathered and summed up,
        one row per split; the records themselves are neither sorted nor shuffled. Rejected
        records leave gaps.
        """
        if "id" in staged.columns:
            return staged, staged.agg(F.max("id")).first()[0] or base
        split = list(ARRIVAL[1:])
        spans = staged.groupBy(*split).agg(
            F.min("src_time").alias("_time"), F.min("src_row").alias("_lo"), F.max("src_row").alias("_hi")
        )
        earlier = Window.orderBy("_time", *split).rowsBetween(Window.unboundedPreceding, -1)
        width = F.col("_hi") - F.col("_lo") + 1
        starts = spans.select(
            *split, "_lo", width.alias("_width"), F.coalesce(F.sum(width).over(earlier), F.lit(0)).alias("_start")
        )
        starts, rows = self._staged_small(starts, "staging_splits", batch_id)
        total = starts.agg(F.coalesce(F.sum("_width"), F.lit(0))).first()[0]
        numbered = staged.join(F.broadcast(starts) if rows <= BROADCAST_ROWS else starts, split).withColumn(
            "id", F.lit(base + 1) + F.col("_start") + F.col("src_row") - F.col("_lo")
        )
        return numbered.drop("_lo", "_width", "_start"), base + total

    def _staged_small(self, df: DataFrame, table: str, batch_id: int) -> tuple[DataFrame, int]:
        """Compute a narrow intermediate result once; its row count decides about broadcasts."""
        seen = Observation()
        path = self._write(df.observe(seen, F.count(F.lit(1)).alias("n")), table, batch_id)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]

    def _batch_bodies(self, good: DataFrame, batch_id: int) -> DataFrame:
        """Counters and rule tests of the batch's bodies, in one aggregate over the content."""
        obs = observations(good, row="src_row")
        tests = self.rules.body_test_columns(F.col("content"))
        tested = obs.select("*", *(c.alias(n) for n, c in tests.items()))
        # All copies of a body test alike, and a boolean maximum keeps the hash aggregate.
        outcome = [F.bool_or(F.when(F.col("content").isNotNull(), F.col(n))).alias(n) for n in tests]
        # The copy that is stored, if the body is new.
        stats = body_stats(tested, F.min("copy").alias("copy"), *outcome)
        path = self._write(stats, "staging_bodies", batch_id)
        stats = self.spark.read.schema(stats.schema).parquet(path)
        self._write(stats.select(*(f.name for f in schemas.BODY_STATS)), "body_stats", batch_id)
        return stats

    def _known_bodies(self, stats: DataFrame, batch_id: int) -> DataFrame:
        """Counters, before this batch, of the bodies in this batch.

        The history is reduced to the batch's keys before it is aggregated; with a batch
        that passes Spark's size check it is filtered in place, without a shuffle.
        """
        history = self._deltas("body_stats", schemas.BODY_STATS, before=batch_id)
        known = merge_body_stats(history.join(stats.select("sha256"), "sha256", "left_semi"))
        return self._staged_small(known, "staging_known", batch_id)[0]

    def _write_bodies(self, good: DataFrame, stats: DataFrame, known: DataFrame, batch_id: int) -> None:
        obs = observations(good, row="src_row")
        found = stats.select("sha256", "size", "is_text", "ever_text", "copy")
        # What is stored already is told by narrow rows, before any body moves.
        unseen, rows = self._staged_small(found.join(known.select("sha256"), "sha256", "left_anti"), "staging_chosen", batch_id)
        content = self._content(obs, unseen, rows, batch_id).select(*(f.name for f in schemas.BODY_CONTENT))
        path = self._write(content.sortWithinPartitions("sha256"), "body_content", batch_id)
        indexable = self.spark.read.schema(schemas.BODY_CONTENT).parquet(path)

        if batch_id > 0:
            # Stored before as binary and served as text now: index it from this batch.
            binary = known.where(~F.col("ever_text")).select("sha256")
            late, rows = self._staged_small(found.where("ever_text").join(binary, "sha256", "left_semi"), "staging_late", batch_id)
            indexable = indexable.unionByName(chosen_content(obs, late, rows))
        index = text_index(indexable, strip_markup=self.strip_markup, chars=self.indexed_chars)
        seen = Observation()
        counts = (F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("words"))
        path = self._write(index.observe(seen, *counts), "body_text", batch_id)
        stored = self.spark.read.schema(schemas.BODY_TEXT).parquet(path)
        self._write(local_postings(stored, seen.get["n"], seen.get["words"] or 0), "body_words", batch_id)

    def _content(self, obs: DataFrame, unseen: DataFrame, rows: int, batch_id: int) -> DataFrame:
        """The content of unseen bodies; the shorter list, theirs or that of the other copies, goes to the content."""
        if rows > BROADCAST_ROWS:
            odd, others = self._staged_small(odd_copies(obs, unseen), "staging_odd", batch_id)
            if others <= BROADCAST_ROWS:
                return content_in_place(obs, odd)
        return chosen_content(obs, unseen, rows)

    def _write_flows(self, good: DataFrame, stats: DataFrame, known: DataFrame, batch_id: int) -> None:
        names = list(self.rules.on_empty_text())
        # The text flag is that of the first observation ever, so history wins.
        before = known.select("sha256", F.col("is_text").alias("_before"))
        flag = F.coalesce("_before", "is_text")
        kept, hot = good.where(~F.col("collapse")), hot_bodies(stats)
        if self.rules.needs_python:
            kept = kept.withColumn("fingerprints", F.array().cast("array<string>"))
            content = distinct_content(observations(good)).join(before, "sha256", "left")
            tagged = tag_flows(kept, content.withColumn("is_text", flag), self.rules, hot=hot)
        else:
            texts = stats.join(before, "sha256", "left").where(flag)
            features = self.rules.informative(texts.select("sha256", *names))
            features, rows = self._staged_small(features, "staging_features", batch_id)
            tagged = self.rules.tag(join_bodies(kept, features, "resp_body_sha", rows=rows, hot=hot))
        known_columns = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in tagged.columns else f.name for f in self.flow_schema]
        self._write_flow_files(tagged.select(*known_columns), f"flows/gen=0/batch_id={batch_id}", ["dt"])

    def _write_flow_files(self, flows: DataFrame, table: str, partitions: list[str]) -> None:
        dated = flows.withColumn("dt", F.to_date("ts"))
        # Adaptive rebalancing splits busy days and merges small ones, so files get an even size.
        keys = ("req_body_sha", "resp_body_sha")  # they move packed
        moved = dated.withColumns({k: packed_key(F.col(k)) for k in keys}).hint("rebalance", *partitions)
        balanced = moved.withColumns({k: unpacked_key(F.col(k)) for k in keys}).sortWithinPartitions(*partitions, "ts")
        (
            balanced.write.mode("overwrite").options(**_PARQUET)
            .partitionBy(*partitions).parquet(f"{self.root}/{table}")
        )

    # -- maintenance -----------------------------------------------------------------

    def retag(self, rules: RuleSet | None = None, *, only_untagged: bool = False) -> int:
        """Tag the whole history again, for example after adding a rule.

        Returns the number of flows looked at. The result is a new generation of the flow
        files; batches that arrive meanwhile are not touched. Later batches are tagged by the
        same rules. Their names are kept with the generation, so that an archive opened
        elsewhere with other rules warns before it stores a batch.

        With ``only_untagged`` no flow file is written: the tags of flows that had none go to
        narrow files of the days they touch, which readers lay over the flows.
        """
        rules = rules or self.rules
        upto = self._max("batch")
        if upto is None:
            return 0
        gen = (self._latest("flows")[0] or 0) + 1
        flows = self.flows().where(F.col("batch_id") <= upto)
        tagged = tag_flows(
            flows, self.body_content(), rules, hot=self.hot_bodies(), only_untagged=only_untagged
        )
        seen = Observation()
        if only_untagged:
            counts = (F.count(F.lit(1)).alias("n"), F.count_if(F.size("fingerprints") > 0).alias("tagged"))
            self._write_tags(tagged.observe(seen, *counts), base=gen - 1)
            n = (self._max("tags") or 0) + 1
            self._register("tags", n, gen - 1, written=seen.get["tagged"], rules=rules.names())
            self.rules = rules
            return seen.get["n"]
        result = tagged.observe(seen, F.count(F.lit(1)).alias("n")).select(*self._stored, "batch_id")
        self._write_flow_files(result, f"flows/gen={gen}", ["batch_id", "dt"])
        self._register("flows", gen, upto, rules=rules.names())
        self.rules = rules
        return seen.get["n"]

    def _write_tags(self, tagged: DataFrame, *, base: int) -> None:
        """New tags as files of their own; a flow is in one of them at most, since it is untagged before."""
        n = (self._max("tags") or 0) + 1
        rows = tagged.where(F.size("fingerprints") > 0).select(
            "id", "fingerprints", F.lit(base).alias("base"), F.lit(n).alias("n"), "dt"
        )
        # Only the partitions that are written are replaced, as a retry needs it.
        (
            rows.hint("rebalance", "dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .options(**_PARQUET).partitionBy("base", "n", "dt").parquet(f"{self.root}/flow_tags")
        )

    def rebuild_flow_agg(self) -> int:
        """Recompute the roll-up from the stored flows only; returns their number.

        Hits of collapsed flows have no stored flow and are lost, which is what a rebuild
        from flows means. `compact` folds the roll-up without losing them.
        """
        seen = Observation()
        flows = self.flows().observe(seen, F.count(F.lit(1)).alias("n"))
        upto = self._max("batch")
        if upto is None:
            return 0
        self._snapshot("shape_stats", shape_stats(flows), upto=upto)
        return seen.get["n"]

    def compact(self) -> None:
        """Fold the per-batch counters into one snapshot each and renew the list of hot bodies.

        The last batch stays a delta, so that a stream may still repeat it.
        """
        last = self._max("batch")
        if last is None:
            return
        self._list_hot_bodies(last)
        if last == 0:
            return
        for table, schema, merge in (
            ("body_stats", schemas.BODY_STATS, merge_body_stats),
            ("shape_stats", schemas.SHAPE_STATS, merge_shape_stats),
        ):
            upto = self._latest(table)[1]
            if upto is None or upto < last:  # a rebuild may have settled the last batch already
                self._snapshot(table, merge(self._deltas(table, schema, before=last)), upto=last - 1)

    def vacuum(self) -> None:
        """Delete files that newer snapshots and generations replaced, and fold their registry rows.

        Run it when no reader that started before the last `compact` or `retag` is active.
        """
        last = self._max("batch")
        if last is None:
            return
        batches = [r["n"] for r in self._registry().where("kind = 'batch'").select("n").collect()]
        folded_upto = []
        for table in ("body_stats", "shape_stats"):
            n, upto = self._latest(table, before=last)
            folded_upto.append(-1 if upto is None else upto)
            self._drop(f"{table}/batch_id", [b for b in batches if upto is not None and b <= upto])
            self._forget(table, f"{table}_snapshot/n", n)
        gen, upto = self._latest("flows")
        if gen is not None:
            self._drop("flows/gen=0/batch_id", [b for b in batches if b <= upto])
            self._forget("flows", "flows/gen", gen)
            # Tags over older generations are part of the newest one.
            old = self._registry().where((F.col("kind") == "tags") & (F.col("upto") < gen)).select("n", "upto").collect()
            self._drop("flow_tags/base", sorted({r["upto"] for r in old}))
            self._drop("registry/kind=tags/n", [r["n"] for r in old])
        self._forget("hot_bodies", "hot_bodies/n", self._latest("hot_bodies")[0])
        settled = [b for b in batches if b <= min(folded_upto)]
        if len(settled) > 1:
            row = (
                self._registry().where((F.col("kind") == "batch") & (F.col("n") <= max(settled)))
                .agg(F.max("last_id").alias("i"), F.sum("written").alias("w"), F.sum("rejected").alias("r")).first()
            )
            self._register("batch", max(settled), max(settled), row["i"], row["w"], row["r"])
            self._drop("registry/kind=batch/n", sorted(settled)[:-1])

    def _forget(self, kind: str, folder: str, newest: int | None) -> None:
        """Drop all but the newest entry of a kind, files and registry rows."""
        entries = self._registry().where(F.col("kind") == kind).select("n").collect()
        old = [r["n"] for r in entries if newest is not None and r["n"] < newest]
        self._drop(f"registry/kind={kind}/n", old)
        self._drop(folder, old)

    def _drop(self, folder: str, numbers: list[int]) -> None:
        for n in numbers:
            remove_path(self.spark, f"{self.root}/{folder}={n}")

    def _list_hot_bodies(self, upto: int | None) -> None:
        if upto is None:
            return
        n = (self._latest("hot_bodies")[0] or 0) + 1
        hot_bodies(self.body_stats()).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/hot_bodies/n={n}")
        self._register("hot_bodies", n, upto)

    def _snapshot(self, table: str, folded: DataFrame, *, upto: int) -> None:
        n = (self._latest(table)[0] or 0) + 1
        folded.write.mode("overwrite").options(**_PARQUET).parquet(f"{self.root}/{table}_snapshot/n={n}")
        self._register(table, n, upto)

    # -- files -----------------------------------------------------------------------

    def _read(self, table: str, schema: StructType) -> DataFrame:
        path = f"{self.root}/{table}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _deltas(self, table: str, schema: StructType, before: int | None = None) -> DataFrame:
        """Rows that fold to the current counters: the last usable snapshot and later batches."""
        deltas = self._read(table, schemas.extend(schema, batch_id=schemas.LONG))
        if before is not None:
            deltas = deltas.where(F.col("batch_id") < before)
        n, upto = self._latest(table, before=before)
        if n is not None:
            snapshot = self.spark.read.schema(schema).parquet(f"{self.root}/{table}_snapshot/n={n}")
            later = deltas.where(F.col("batch_id") > upto).drop("batch_id")
            return snapshot.unionByName(later)
        return deltas.drop("batch_id")

    def _write(self, df: DataFrame, table: str, batch_id: int) -> str:
        path = f"{self.root}/{table}/batch_id={batch_id}"
        options = dict(_BODY_PARQUET if table == "body_content" else _PARQUET)
        if table in ("body_words", "body_text"):
            options["parquet.dictionary.page.size"] = str(DICTIONARY)
        for key in ("sha256", "word"):
            if key in df.columns and table not in _STAGING:
                # Point lookups skip files and row groups that cannot hold the key.
                options[f"parquet.bloom.filter.enabled#{key}"] = "true"
        df.write.mode("overwrite").options(**options).parquet(path)
        return path

    def _registry(self) -> DataFrame:
        return self._read("registry", schemas.REGISTRY)

    def _register(
        self, kind: str, n: int, upto: int, last_id: int = 0, written: int = 0, rejected: int = 0,
        rules: list[str] | None = None,
    ) -> None:
        row = self.spark.createDataFrame(
            [(upto, last_id, written, rejected, rules)],
            "upto bigint, last_id bigint, written bigint, rejected bigint, rules array<string>",
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/registry/kind={kind}/n={n}")

    def _max(self, kind: str) -> int | None:
        return self._registry().where(F.col("kind") == kind).agg(F.max("n")).first()[0]

    def _latest(self, kind: str, before: int | None = None) -> tuple[int | None, int | None]:
        entries = self._registry().where(F.col("kind") == kind)
        if before is not None:
            entries = entries.where(F.col("upto") < before)
        last = entries.agg(F.max(F.struct("n", "upto")).alias("e")).first()["e"]
        return (last["n"], last["upto"]) if last else (None, None)

    def _last_id(self, before: int) -> int:
        batches = self._registry().where((F.col("kind") == "batch") & (F.col("n") < before))
        return batches.agg(F.max("last_id")).first()[0] or 0
