"""Span trees with cycles and orphans, and percentile sketches."""

import random

from trafficlens.operators.details import span_tree
from trafficlens.operators.metrics import response_time_sketches, rollup

SPANS = "app_id int, request_uuid string, span_id string, parent_span_id string, name string, start_time_ns bigint"


def brute_force(rows):
    """rows: (request, span, parent, start) -> {(request, span): (depth, n_children, place, subtree, cycle)}"""
    parent = {(r, s): (r, p) for r, s, p, _ in rows}
    start = {(r, s): t for r, s, _, t in rows}
    above = {}
    for k in parent:
        seen, at = [], k
        while (at := parent.get(at)) in parent and at not in seen:
            seen.append(at)
        above[k] = None if k in seen or parent[k] not in parent else parent[k]
    cycle = {k for k in parent if above[k] is None and parent[k] in parent}
    depth = lambda k: 0 if above[k] is None else 1 + depth(above[k])
    kids = {k: [c for c in above if above[c] == k] for k in parent}
    size = lambda k: 1 + sum(size(c) for c in kids[k])
    out = {}
    for k in parent:
        siblings = kids[above[k]] if above[k] else [x for x in parent if above[x] is None and x[0] == k[0]]
        out[k] = (depth(k), len(kids[k]), 1 + sum((start[x], x[1]) < (start[k], k[1]) for x in siblings), size(k), k in cycle)
    return out


def test_deep_orphaned_and_cyclic_spans(spark):
    rng = random.Random(2)
    rows = [("loop", "a", "c", 1), ("loop", "b", "a", 2), ("loop", "c", "b", 3), ("loop", "d", "b", 4), ("loop", "e", "d", 5), ("self", "x", "x", 1), ("self", "y", "x", 2),
            ("orphan", "o", "gone", 1), ("orphan", "p", "o", 2)]
    rows += [("deep", f"s{i}", f"s{i - 1}" if i else None, i) for i in range(70)]
    rows += [("long", f"l{i}", f"l{(i + 1) % 37}", i) for i in range(37)] + [("long", f"t{i}", f"t{i - 1}" if i else "l5", i) for i in range(20)]
    rows += [(f"r{k}", f"n{i}", f"n{rng.randrange(30)}" if rng.random() < 0.9 else None, rng.randrange(9)) for k in range(12) for i in range(25)]
    df = spark.createDataFrame([(1, r, s, p, f"name {s}", t) for r, s, p, t in rows], SPANS)
    got = {(r.request_uuid, r.span_id): (r.depth, r.n_children, r.place, r.subtree, r.cycle) for r in span_tree(df).collect()}
    assert got == brute_force(rows)
    path = {r.span_id: r.path for r in span_tree(df.filter("request_uuid = 'loop'")).collect()}
    assert path["e"] == "name b > name d > name e" and path["a"] == "name a"


def test_rollup_percentiles_within_the_rank_error(spark):
    """More rows a bucket than the sketch retains: the answer's rank is near the asked one."""
    rows = spark.range(60_000).selectExpr("1 AS app_id", "timestamp_seconds(1735689600 + id % 1800) AS timestamp", "cast(pmod(id * 7919, 60000) as int) AS response_time_ms", "500 AS status_code")
    minute = rows.selectExpr("app_id", "date_trunc('minute', timestamp) AS period_start").groupBy("app_id", "period_start").count() \
        .selectExpr("app_id", "period_start", "count AS requests", "0L AS bytes_received", "0L AS bytes_sent", "0L AS client_errors", "count AS server_errors")
    stored = minute.join(response_time_sketches(rows, 60, k=400), ["app_id", "period_start"])
    out = rollup(rollup(stored, 600, k=400), 1800, k=400).collect()  # two tiers
    assert len(out) == 1 and out[0].requests == 60_000
    for name, p in (("response_time_p50", 0.5), ("response_time_p75", 0.75), ("response_time_p90", 0.9), ("response_time_p95", 0.95), ("response_time_p99", 0.99)):
        assert abs(out[0][name] / 60_000 - p) < 0.02, name
