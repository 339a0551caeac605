"""Technology rules over the whole history.

A rule is a name and a function from a `RuleContext` to a boolean column. Tests on the
body text go through `RuleContext.body_test`: they depend on nothing but the body, so
they are evaluated once per distinct body and only their outcome is joined to the flows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import lower_keys
from ..functions.text import utf8_text
from ..session import stored_once
from .bodies import join_bodies
from .joins import hot_keys, lookup

BodyTest = Callable[[Column], Column]


@dataclass
class RuleContext:
    """What a rule may look at. Also records the body tests that the rules ask for."""

    body_tests: list[BodyTest] = field(default_factory=list)

    @property
    def status(self) -> Column:
        return F.col("_status")

    @property
    def headers(self) -> Column:
        """Response headers with lower-case keys."""
        return F.col("_headers")

    @property
    def cookies(self) -> Column:
        return self.header("set-cookie")

    @property
    def server(self) -> Column:
        return self.header("server")

    def header(self, name: str) -> Column:
        """Lower-cased value of a header; empty when absent."""
        return F.lower(F.coalesce(F.try_element_at(self.headers, F.lit(name.lower())), F.lit("")))

    def has_header(self, name: str) -> Column:
        return F.map_contains_key(self.headers, name.lower())

    def any_header_name_has(self, text: str) -> Column:
        return F.exists(F.map_keys(self.headers), lambda k: F.contains(k, F.lit(text)))

    def any_header_value_has(self, text: str) -> Column:
        return F.exists(
            F.map_values(self.headers), lambda v: F.contains(F.lower(v), F.lit(text))
        )

    def body_test(self, test: BodyTest) -> Column:
        """Outcome of ``test(text)``; bodies that are not text count as the empty text."""
        self.body_tests.append(test)
        return F.col(f"_bt{len(self.body_tests) - 1}")


@dataclass(frozen=True)
class Rule:
    name: str
    match: Callable[[RuleContext], Column]


@dataclass(frozen=True)
class PythonRule:
    """Escape hatch: a plain predicate over (status, headers, body). Slow, see README."""

    name: str
    match: Callable[[int, dict[str, str], str], bool]


def _has(text: Column, needle: str) -> Column:
    return F.contains(text, F.lit(needle))


def _head(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


# Tag names, their order, the marks looked for and the prefix lengths.
RULES: list[Rule] = [
    Rule("f5-big-ip", lambda c: _has(c.cookies, "bigipserver") | c.has_header("x-cnection")),
    Rule("akamai", lambda c: _has(c.server, "akamaighost") | c.any_header_name_has("x-akamai")),
    Rule("cloudfront", lambda c: _has(c.header("via"), "cloudfront") | c.has_header("x-amz-cf-id")),
    Rule("cloudflare", lambda c: _has(c.server, "cloudflare") | c.has_header("cf-ray")),
    Rule(
        "apigee",
        lambda c: c.any_header_value_has("apigee")
        | c.body_test(lambda text: _has(_head(text, 2000), '"fault"')),
    ),
    Rule(
        "aem-dispatcher",
        lambda c: _has(c.header("x-vhost"), "dispatcher") | _has(c.header("x-cq"), "cq"),
    ),
    Rule("nginx", lambda c: _has(c.server, "nginx")),
    Rule("apache", lambda c: _has(c.server, "apache")),
    Rule(
        "iis-aspnet",
        lambda c: c.any_header_value_has("asp.net") | c.has_header("x-aspnet-version"),
    ),
    Rule(
        "graphql",
        lambda c: c.body_test(
            lambda text: _has(_head(text, 500), '"errors"')
            & _has(F.lower(_head(text, 2000)), "graphql")
        ),
    ),
    Rule(
        "waf-generic",
        lambda c: c.status.isin(403, 406, 419)
        & c.body_test(
            lambda text: _has(F.lower(_head(text, 500)), "access denied")
            | _has(F.lower(_head(text, 500)), "request blocked")
        ),
    ),
]


class RuleSet:
    """An ordered list of rules, bound to the columns they need."""

    def __init__(self, rules: Iterable[Rule | PythonRule] = RULES):
        self.rules: Sequence[Rule | PythonRule] = list(rules)
        self._context = RuleContext()
        self._conditions: dict[str, Column] = {}
        for rule in self.rules:
            if isinstance(rule, Rule):
                self._conditions[rule.name] = rule.match(self._context)

    def names(self) -> list[str]:
        return [rule.name for rule in self.rules]

    @property
    def needs_python(self) -> bool:
        return any(isinstance(r, PythonRule) for r in self.rules)

    def body_test_columns(self, content: Column) -> dict[str, Column]:
        """The body tests over body bytes, by column name."""
        text = utf8_text(content)
        return {
            f"_bt{i}": F.coalesce(test(text), F.lit(False))
            for i, test in enumerate(self._context.body_tests)
        }

    def on_empty_text(self) -> dict[str, Column]:
        """The body tests for flows without a text body; folded to constants."""
        return {
            f"_bt{i}": F.coalesce(test(F.lit("")), F.lit(False))
            for i, test in enumerate(self._context.body_tests)
        }

    def body_features(self, content: DataFrame) -> DataFrame:
        """Outcome of the body tests, one narrow row per distinct body."""
        tests = self.body_test_columns(F.col("content"))
        return self.informative(content.select("sha256", *(c.alias(n) for n, c in tests.items())))

    def informative(self, features: DataFrame) -> DataFrame:
        """Leave out bodies that test like the empty text: a missing row means the same."""
        differs = F.lit(False)
        for name, default in self.on_empty_text().items():
            differs = differs | (F.col(name) != default)
        return features.where(differs)

    def tag(self, flows: DataFrame) -> DataFrame:
        """Add ``fingerprints``, tags in rule order, to flows that carry the body tests."""
        context = flows.withColumns(
            {
                "_status": F.coalesce(F.col("status"), F.lit(0)),
                "_headers": lower_keys(F.col("resp_headers")),
                **{
                    name: F.coalesce(F.col(name), default)
                    for name, default in self.on_empty_text().items()
                },
            }
        )
        hits = []
        for rule in self.rules:
            if isinstance(rule, PythonRule):
                condition = F.coalesce(F.array_contains("_python", rule.name), F.lit(False))
            else:
                condition = self._conditions[rule.name]
            hits.append(F.when(condition, F.lit(rule.name)))
        tags = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
        return context.withColumn("fingerprints", tags).drop(
            "_status", "_headers", "_python", *self.on_empty_text()
        )


def _python_tags(rules: Sequence[PythonRule]) -> Callable[[Column, Column, Column], Column]:
    """The names of the Python rules that match (status, headers, body), in Arrow batches."""
    matches = [(rule.name, rule.match) for rule in rules]

    @F.pandas_udf("array<string>")
    def run(status: pd.Series, headers: pd.Series, body: pd.Series) -> pd.Series:
        def safe(match, s, h, b):
            try:
                return bool(match(int(s), dict(h), b))
            except Exception:  # a rule that fails on a flow does not match it
                return False

        rows = zip(status, headers, body)
        return pd.Series([[name for name, match in matches if safe(match, *row)] for row in rows], dtype=object)

    return run.asNondeterministic()  # so that the optimiser does not repeat the call in a filter


def python_outcomes(flows: DataFrame, content: DataFrame, rules: RuleSet, *, hot: DataFrame | None = None) -> tuple[DataFrame, int]:
    """`_input, _python` of the distinct inputs that a Python rule matches, and their number.

    Flows with equal status, headers and body key have one outcome, so a predicate is called once
    for all of them, and no body stands beside a flow.
    """
    inputs = flows.select(
        _input_key().alias("_input"), F.coalesce("status", F.lit(0)).alias("_status"),
        lower_keys(F.col("resp_headers")).alias("_headers"), "resp_body_sha",
    )
    distinct = inputs.groupBy("_input", "_status", "resp_body_sha").agg(F.any_value("_headers").alias("_headers"))
    texts = content.where("is_text").select("sha256", utf8_text(F.col("content")).alias("_text"))
    joined = lookup(distinct, texts, "resp_body_sha", table_key="sha256", hot=hot, row_id="_input")
    run = _python_tags([r for r in rules.rules if isinstance(r, PythonRule)])
    tagged = joined.select("_input", run(F.col("_status"), F.col("_headers"), F.coalesce("_text", F.lit(""))).alias("_python"))
    return stored_once(tagged.where(F.size("_python") > 0), "python-outcomes")


def _input_key() -> Column:
    """What a Python rule may look at, as one key; headers in order of their names."""
    headers = F.to_json(F.array_sort(F.map_entries(lower_keys(F.col("resp_headers")))))
    return F.sha2(F.concat_ws("\n", F.coalesce("status", F.lit(0)).cast("string"), F.coalesce("resp_body_sha", F.lit("")), headers), 256)


def tag_flows(
    flows: DataFrame,
    content: DataFrame,
    rules: RuleSet | None = None,
    *,
    hot: DataFrame | None = None,
    only_untagged: bool = False,
) -> DataFrame:
    """(Re)compute ``fingerprints`` of every flow; replaces earlier tags.

    ``flows`` are stored flows, ``content`` the distinct bodies (``sha256, is_text,
    content``); bodies not first seen as text count as empty. The body tests run on the
    content scan itself, so no body is shuffled. With ``only_untagged`` the result holds
    just the flows that had no tag before.
    """
    rules = rules or RuleSet()
    if only_untagged:
        flows = flows.where(F.size("fingerprints") == 0)
    flows = flows.drop("fingerprints")
    texts = content.where("is_text")
    payload, rows = stored_once(rules.body_features(texts), "rule-features")
    joined = join_bodies(flows, payload, "resp_body_sha", rows=rows, hot=hot)
    if rules.needs_python:
        outcomes, found = python_outcomes(flows, content, rules, hot=hot)
        keyed = joined.withColumn("_of_input", _input_key())
        counts = keyed.groupBy(F.col("_of_input").alias("_input")).agg(F.count("*").alias("_n"))
        joined = lookup(
            keyed, outcomes, "_of_input", table_key="_input", table_rows=found, hot=hot_keys(counts, "_input", "_n")
        ).drop("_of_input")
    return rules.tag(joined)
