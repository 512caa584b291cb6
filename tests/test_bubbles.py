"""Bubbles and stretches against plain walks on small random graphs."""

import random

import pytest

from strandflow.operators import debruijn as G


def brute(edges, most):
    """Every simple path, a level at a time, until two of a start meet."""
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    found = []
    for start in sorted(out):
        if len(out[start]) < 2:
            continue
        paths = [(start, b) for b in out[start]]
        for _ in range(most):
            ends = [p[-1] for p in paths]
            met = sorted(e for e in set(ends) if ends.count(e) > 1)
            if met:
                two = sorted(p for p in paths if p[-1] == met[0])[:2]
                weight = [sum(edges[e] for e in zip(p, p[1:])) for p in two]
                if weight[1] > weight[0]:
                    two, weight = two[::-1], weight[::-1]
                found.append((start, met[0], [list(p) for p in two], weight))
                break
            paths = [(*p, n) for p in paths if p[-1] != start for n in out.get(p[-1], []) if n == start or n not in p]
    return found


def graphs():
    rng = random.Random(11)
    for n, dense in ((6, 1.5), (9, 1.2), (14, 1.4), (25, 1.3), (25, 1.9), (40, 1.1)):
        edges = {(i, i + 1): rng.randint(1, 9) for i in range(n - 1) if rng.random() < 0.8}
        while len(edges) < n * dense:
            edges[rng.randrange(n), rng.randrange(n)] = rng.randint(1, 9)
        yield edges
    # two bubbles in a row, one within the other, a loop, and a stretch that is longer than the limit
    yield {(0, 1): 1, (1, 2): 1, (0, 3): 2, (3, 2): 2, (2, 4): 1, (4, 6): 1, (2, 5): 1, (5, 6): 3, (6, 6): 1, (6, 7): 1} | {(i, i + 1): 1 for i in range(7, 30)} | {(6, 31): 1} | {(i, i + 1): 1 for i in range(31, 53)} | {(53, 30): 1}


@pytest.mark.parametrize("most", [5, 30])
def test_bubbles_equal_plain_walks(spark, most):
    """All graphs side by side, their nodes numbered apart."""
    edges = {(a + 1000 * i, b + 1000 * i): c for i, g in enumerate(graphs()) for (a, b), c in g.items()}
    df = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "src long, dst long, cnt long")
    got = sorted((r["start"], r["end"], r["paths"], r["weights"]) for r in G.find_bubbles(df, G.Simplification(bubble_max_length=most)).collect())
    assert got == sorted(brute(edges, most)) and got


def test_stretches_hold_every_edge_once(spark):
    edges = list(graphs())[-1]
    df = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "src long, dst long, cnt long")
    rows = G.stretches(df, 100).collect()
    assert len(rows) == len(edges) and sum(r["cnt"] for r in rows) == sum(edges.values())
    by = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        by.setdefault((r["head"], r["via"]), [r["head"]]).append(r["node"])
    assert all(e in edges for path in by.values() for e in zip(path, path[1:])) and max(map(len, by.values())) == 25
    assert max(r["place"] for r in G.stretches(df, 7).collect()) == 7


def test_bubbles_take_jobs_that_do_not_grow_with_their_junctions(spark):
    # a ladder of 30 junctions, of which only the last two paths meet at equal length: one round each was 30 rounds of three writes
    rows = [(i, i + 1, 5) for i in range(60)] + [(2 * i, 1000 + i, 1) for i in range(1, 30)] + [(0, 100, 2)] + [(100 + i, 101 + i, 2) for i in range(58)] + [(158, 60, 2)]
    edges = spark.createDataFrame(rows, "src long, dst long, cnt long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ladder", "")
    found = G.find_bubbles(edges).collect()
    n = len(tracker.getJobIdsForGroup("ladder"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r.start, r.end, [len(p) for p in r.paths], r.weights) for r in found] == [(0, 60, [61, 61], [300, 120])]
    assert n < 150, n


def test_regions_are_held_once_for_starts_that_share_them(spark, monkeypatch):
    # 40 forks in a row whose ways differ in length: the regions of single starts hold 40 * 41 / 2 junctions and more
    rows = [(i, 1000 + i, i + 1, n) for i in range(40) for n in (1, 2)]
    whole = spark.createDataFrame(rows, "head long, via long, to long, edges int")
    starts = whole.groupBy("head").count().where("count > 1").selectExpr("head AS start")
    found = G._regions(whole, starts, 100).collect()
    assert sorted(r.head for r in found if r.begins) == list(range(40)) and len(found) < 300
    # groups are split where many starts come to one label, and still reach all they have to
    monkeypatch.setattr(G, "GROUP", 8)
    found = G._regions(whole, starts, 5).collect()
    by = {}
    for r in found:
        by.setdefault(r.group, {})[r.head] = r.begins
    assert len(by) >= 5 and sorted(h for g in by.values() for h, b in g.items() if b) == list(range(40))
    assert all({*range(s, min(s + 5, 41))} <= {*g} for g in by.values() for s, b in g.items() if b)
