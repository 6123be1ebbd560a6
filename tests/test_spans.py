"""Spans and lines: as brute force has them, and no join makes rows with the product of a file's lines and spans."""

import random

import pytest

from loomgraph.operators import history

LINES = "k long, sha string, file string, line int, sign string"
SPANS = "file string, start int, `end` int, id string, ord long"


def listed(seq):
    return [seq.apply(k) for k in range(seq.size())]


def join_rows(spark, work):
    """What work() gives, and the most rows that a join made meanwhile."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {e.executionId() for e in listed(store.executionsList())}
    out = work()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most = 0
    for e in listed(store.executionsList()):
        if e.executionId() not in before:
            values = store.executionMetrics(e.executionId())
            for node in listed(store.planGraph(e.executionId()).allNodes()):
                for m in listed(node.metrics()):
                    if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return out, most


def innermost(spans, file, line):
    held = [(start - end, order, id_) for f, start, end, id_, order in spans if f == file and start <= line <= end]
    return max(held)[2] if held else None


def nearest(spans, file, line, reach=9):
    around = [(abs(line - start), start > line, order, id_) for f, start, _, id_, order in spans if f == file and abs(line - start) <= reach]
    return min(around)[3] if around else None


@pytest.fixture(scope="module")
def crowd(spark):
    """One file: 1,500 lines at 30 places under 1,200 spans of which many are equal."""
    rng = random.Random(3)
    spans = [("a", s := rng.randint(0, 25), s + rng.randint(0, 20), f"s{k}", k) for k in range(1200)]
    lines = [(k, f"c{rng.randint(0, 40)}", "a", k % 30, "+-"[k % 3 == 0]) for k in range(1500)]
    return lines, spans, spark.createDataFrame(lines, LINES), spark.createDataFrame(spans, SPANS)


def churn(lines, spans):
    found = {}
    for _, sha, file, line, sign in lines:
        if (id_ := innermost(spans, file, line)) is not None:
            found.setdefault(id_, []).append((sha, sign))
    return {id_: (len({s for s, _ in x}), sum(s == "+" for _, s in x), sum(s == "-" for _, s in x)) for id_, x in found.items()}


def test_impact_of_a_crowd(spark, crowd):
    lines, spans, line_rows, span_rows = crowd
    got, most = join_rows(spark, lambda: history.impact(line_rows, span_rows, 5).collect())
    want = sorted(((-a - r, id_, c, a, r) for id_, (c, a, r) in churn(lines, spans).items()))[:5]
    assert [(-x["changed"], x["id"], x["commits"], x["added"], x["removed"]) for x in got] == want
    assert 0 < most <= len(lines)


def test_churn_of_a_crowd(spark, crowd):
    lines, spans, line_rows, span_rows = crowd
    got, most = join_rows(spark, lambda: history.symbol_churn(line_rows, span_rows).collect())
    assert {x["id"]: (x["commits"], x["added"], x["removed"]) for x in got} == churn(lines, spans)
    assert 0 < most <= len(lines)


def test_lines_of_a_crowd(spark, crowd):
    lines, spans, line_rows, span_rows = crowd
    got, most = join_rows(spark, lambda: history.attribute(line_rows.select("k", "file", "line"), span_rows).collect())
    assert sorted(map(tuple, got)) == [(k, f, n, id_) for k, _, f, n, _ in lines if (id_ := innermost(spans, f, n)) is not None]
    assert 0 < most <= len(lines)


def test_odd_spans(spark):
    """Lines below zero, long spans, spans that end before they start, equal spans, nulls, files without spans, repeated lines."""
    rng = random.Random(8)
    spans = [(rng.choice("ab"), s := rng.randint(-300, 300), s + rng.choice([-3, 0, 1, 7, 60, 400]), f"s{k}", k) for k in range(150)] + [("a", 5, 9, "x", 1000), ("a", 5, 9, "y", 1001)]
    lines = [(k, "c", rng.choice("abc"), rng.randint(-350, 750), "+") for k in range(600)]
    rows = spark.createDataFrame(lines + lines[:9] + [(-1, "c", None, 3, "+"), (-2, "c", "a", None, "+")], LINES).select("k", "file", "line")
    held = spark.createDataFrame(spans + [(None, 1, 2, "n", 1), ("a", None, 2, "n", 2), ("a", 1, None, "n", 3)], SPANS)
    got = sorted(map(tuple, history.attribute(rows, held).collect()))
    assert got == [(k, f, n, id_) for k, _, f, n, _ in lines if (id_ := innermost(spans, f, n)) is not None]
    assert history.attribute(rows, held.limit(0)).count() == 0


def test_nearest_in_a_crowd(spark, crowd):
    lines, spans, line_rows, span_rows = crowd
    rows = line_rows.select("k", "file", (line_rows.line * 2 - 12).alias("line"))
    got, most = join_rows(spark, lambda: history.nearest_span(rows, span_rows).collect())
    assert sorted(map(tuple, got)) == [(k, f, 2 * n - 12, id_) for k, _, f, n, _ in lines if (id_ := nearest(spans, f, 2 * n - 12)) is not None]
    assert 0 < most <= len(lines)
