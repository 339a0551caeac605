import corpus_pipeline
from test_neardup import brute_set

import __spark_entry__ as entry
from wirevault.llm import decontam, queries
from wirevault.llm.common import stored


def test_stages_keep_what_they_should(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before, kept = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small), "test-stage")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert len(kept["language ID"]) >= 0.99 * before.count()
    # No near duplicates are left, and every document that went has a link to another that was there.
    sets = {i: brute_set(t, 5) for i, t in kept["language ID"].items()}
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b) > 0
    stay = kept["near-duplicates"]
    assert not any(alike(sets[i], sets[j]) for i in stay for j in stay if i < j)
    assert all(any(alike(sets[i], sets[j]) for j in sets if j != i) for i in set(sets) - set(stay))
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    marked = decontam.marked(before.select("doc_id", "text"), benchmark).where("_n_hit > 0").select("doc_id").collect()
    assert set(kept["decontamination"]) == set(stay) - {r.doc_id for r in marked}
    assert set(kept["mixing"]) <= set(kept["decontamination"])
    assert set(kept["sharding"]) == set(kept["mixing"])
    assert docs.where("shard NOT BETWEEN 0 AND 39").count() == 0


def test_everything_is_registered():
    names = set(entry.queries())
    assert set(queries.queries()) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))
    assert set(queries.oracle_sql()) <= names


def test_stages_take_odd_and_empty_tables(spark, frame, odd_rows, small):
    docs = frame(odd_rows)
    for name, stage in corpus_pipeline.STAGES[1:]:
        found, none = stage(spark, docs, small), stage(spark, docs.limit(0), small)
        if stage is not corpus_pipeline.shard:
            assert found.columns == docs.columns, name
        assert none.columns == found.columns and none.count() == 0, name
        ids = [r.doc_id for r in found.collect()]
        assert set(ids) <= {i for i, *_ in odd_rows}, name
        if stage in (corpus_pipeline.clean_of_benchmarks, corpus_pipeline.shard):
            assert len(ids) == len(odd_rows), name
