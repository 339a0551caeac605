"""Physical plans: what must and must not appear."""

import pytest
from pyspark.sql import functions as F

from wirevault.operators import bodies as B
from wirevault.operators import replay, rollup, search, stats
from wirevault.operators.postings import bodies_with_words
from wirevault.operators.tagging import tag_flows
from wirevault.plans.capture_view import capture_flows
from wirevault.plans.queries import archive_of


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def archive(spark, small):
    return archive_of(spark, small)


def test_listing_reads_no_bodies_and_pushes_filters(archive):
    text = plan(search.search(archive.flows(), status=403, program="prog-1", tech=["nginx"], since="2024-01-05"))
    assert "TakeOrderedAndProject" in text and "content" not in text and "Exchange" not in text
    assert "EqualTo(status,403)" in text and "EqualTo(program,prog-1)" in text
    assert "PartitionFilters" in text and "dt#" in text.split("PartitionFilters")[1].split("\n")[0]
    read = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "resp_headers" not in read and "resp_body_sha" not in read


def test_body_search_has_no_nested_loop(archive):
    for predicate in ({"grep": "the"}, {"body": "the"}):
        for hot in (None, archive.hot_bodies()):
            text = plan(search.search(archive.flows(), body_text=archive.body_text(), hot=hot, **predicate))
            assert "NestedLoop" not in text and "Cartesian" not in text


def test_body_search_reads_the_words_of_the_phrase(archive):
    for phrase, pushed in (("Denied", "EqualTo(word,denied)"), ("access Denied", "In(word, [access,denied])")):
        text = plan(bodies_with_words(archive.body_words(), phrase))
        assert pushed in text, text
        assert "NestedLoop" not in text and text.count("hashpartitioning(") <= 1
    for predicate in ({"grep": "the"}, {"body": "the"}):
        text = plan(search.search(archive.flows(), body_words=archive.body_words(), hot=archive.hot_bodies(), **predicate))
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_built_in_rules_stay_in_the_jvm(archive):
    text = plan(tag_flows(archive.flows(), archive.body_content(), hot=archive.hot_bodies()))
    assert "Python" not in text and "NestedLoop" not in text and "Cartesian" not in text


def test_counters_are_hash_aggregated_before_the_shuffle(archive):
    text = plan(archive.body_stats())
    assert "SortAggregate" not in text and "partial_" in text


def test_content_is_combined_before_the_shuffle(spark, small):
    obs = B.observations(B.with_body_keys(capture_flows(spark, small)))
    text = plan(B.dedup_bodies(obs), "simple")
    # Two aggregations, each with a partial step below its exchange.
    assert text.count("partial_first(content") == 2 and text.count("Exchange hashpartitioning(sha256") == 2


def test_facets_read_only_tags(archive):
    text = plan(stats.tech_facets(archive.flows()))
    read = text.split("ReadSchema: ")[1].split("\n")[0]
    assert read == "struct<fingerprints:array<string>>"


def test_rollup_reads_narrow(archive):
    text = plan(rollup.rollup(archive.flows()))
    read = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "headers" not in read and "url" not in read


def test_point_lookup_is_pushed_down(archive):
    key = archive.body_content().first().sha256
    text = plan(archive.body_content().where(F.col("sha256") == key))
    assert f"EqualTo(sha256,{key})" in text


def test_roll_up_is_hash_aggregated(archive):
    for agg in (rollup.rollup(archive.flows()), archive.flow_agg()):
        text = plan(agg)
        assert "SortAggregate" not in text and "partial_" in text and "NestedLoop" not in text


def test_matrix_moves_no_request(archive):
    text = plan(replay.request_matrix(archive.flows().withColumn("req_body", F.lit(None).cast("binary")), [{"name": "a"}, {"name": "b"}]))
    assert "Exchange" not in text and "Join" not in text
