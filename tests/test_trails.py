"""Trails of all walks at once against walks one after the other."""

import random

import pytest

from strandflow.functions.dna import BASES
from strandflow.operators import debruijn as G


def graph_of(rng, k, pieces):
    """Edges of a k-mer graph of random reads that share stretches, with random weights."""
    edges, mask = {}, (1 << 2 * (k - 1)) - 1
    for text in pieces:
        codes = [BASES.index(b) for b in text]
        for i in range(len(codes) - k + 1):
            code = 0
            for c in codes[i : i + k]:
                code = code << 2 | c
            edges[code >> 2, code & mask] = rng.randint(1, 4)
    return edges


def walked(edges, heavy):
    """Trails (lists of edges) of walks one after the other; ties by node."""
    out, into = {}, {}
    for (a, b), c in edges.items():
        out.setdefault(a, []).append((-c if heavy else 0, b))
        into[b] = into.get(b, 0) + 1
    for ways in out.values():
        ways.sort()
    excess = {n: len(ways) - into.get(n, 0) for n, ways in out.items()}
    inner = {n for n in out if len(out[n]) == 1 and into.get(n, 0) == 1}
    starts = sorted((n for n in out if excess[n] > 0), key=lambda n: (-excess[n], n))
    starts += sorted(n for n in out if excess[n] <= 0 and n not in inner) + sorted(inner)
    used, trails = set(), []
    for n in starts:
        for _, b in out[n]:
            if (n, b) in used:
                continue
            trail, now = [], (n, b)
            while now:
                used.add(now)
                trail.append(now)
                now = next(((now[1], x) for _, x in out.get(now[1], []) if (now[1], x) not in used), None)
            trails.append(trail)
    return trails


def found(df, heavy):
    by = {}
    for r in G.greedy_trails(df, heavy).collect():
        by.setdefault(r["trail"], []).append((r["rank"], (r["src"], r["dst"])))
    assert all(sorted(x for x, _ in t) == list(range(len(t))) for t in by.values())
    return sorted([e for _, e in sorted(t)] for t in by.values())


@pytest.mark.parametrize("k,heavy", [(3, True), (5, False)])
def test_greedy_trails_equal_walks_one_by_one(spark, k, heavy):
    rng = random.Random(k + heavy)
    base = ["".join(rng.choice(BASES) for _ in range(40)) for _ in range(3)]
    pieces = base + [rng.choice(base)[rng.randrange(30) :][:12] + rng.choice(base)[rng.randrange(30) :][:15] for _ in range(6)]
    pieces += ["ACACACACAC", "G" * 12, "".join(rng.choice("AT") for _ in range(30))]
    edges = graph_of(rng, k, pieces)
    df = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "src long, dst long, cnt long")
    assert found(df, heavy) == sorted(walked(edges, heavy))


def test_circles_only(spark):
    edges = graph_of(random.Random(1), 3, ["ATCATCATC", "GG" * 4])
    df = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "src long, dst long, cnt long")
    assert found(df, True) == sorted(walked(edges, True))
    assert G.greedy_trails(df.limit(0)).count() == 0
