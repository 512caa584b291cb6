"""Graphs as pieces against the same work edge by edge."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandflow.operators import debruijn as G
from strandflow.operators import pieces as P


def random_edges():
    """Chains with tips, forks and loops, and circles without junctions."""
    rng = random.Random(5)
    edges = {(i, i + 1): rng.randint(1, 5) for i in range(120) if i % 37}
    for _ in range(14):
        at, to, far = rng.randrange(120), rng.randrange(120), 1000 + 20 * len(edges)
        path = [at, *range(far, far + rng.randint(1, 6)), *([to] if rng.random() < 0.5 else [])]
        edges.update({e: rng.randint(1, 3) for e in zip(path, path[1:])})
    for n, begin in ((1, 9000), (2, 9100), (9, 9200)):
        edges.update({(begin + i, begin + (i + 1) % n): rng.randint(1, 5) for i in range(n)})
    return edges


def frame(spark, edges):
    return spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "src long, dst long, cnt long")


def rows(df):
    return sorted((r["src"], r["dst"], r["cnt"]) for r in df.select("src", "dst", "cnt").collect())


def paired(edges):
    """Trails by pairing at each node, followed one at a time; circles from their least edge."""
    into, out, on = {}, {}, {}
    for (a, b), c in edges.items():
        out.setdefault(a, []).append((-c, b, (a, b)))
        into.setdefault(b, []).append((-c, a, (a, b)))
    for n in into:
        on.update({x[2]: y[2] for x, y in zip(sorted(into[n]), sorted(out.get(n, [])))})
    code = lambda e: e[0] << 2 | e[1] & 3
    left, trails = set(edges), []
    for e in sorted(set(edges) - set(on.values())) + sorted(edges, key=code):
        trail = []
        while e in left:
            left.remove(e)
            trail.append(e)
            e = on.get(e)
        trails += [trail] if trail else []
    return sorted(trails)


def test_pieces_hold_every_edge_once_however_rows_are_sliced(spark, monkeypatch):
    edges = random_edges()
    pieces = P.Pieces.of(frame(spark, edges))
    assert rows(pieces.edges()) == sorted((a, b, c) for (a, b), c in edges.items())
    assert pieces.short.count() < len(edges) / 2
    ends = [(a, b, c) for (a, b), c in edges.items()]
    both = sorted([(a, b, True, c) for a, b, c in ends] + [(b, a, False, c) for a, b, c in ends])
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*both)], names=["node", "other", "out", "cnt"])
    for size in (3, 17, 1000):
        monkeypatch.setattr(P, "SLICE_ROWS", size)
        found = [r for made in P._join(batch.slice(i, 2) for i in range(0, len(both), 2)) for r in made.to_pylist()]
        assert sorted(e for r in found for e in zip([r["head"], *r["nodes"]], r["nodes"], r["cnts"])) == sorted(ends)
    assert isinstance(found[0]["nodes"], list) and np.mean([len(r["nodes"]) for r in found]) > 2


def test_simplify_by_pieces_equals_rounds_over_edges(spark):
    edges, conf = frame(spark, random_edges()), G.Simplification(5, 2.0, 40, 4)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("simplify", "")
    found, done = G.simplify(edges, conf)
    found = rows(found)
    jobs = len(tracker.getJobIdsForGroup("simplify"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    n_tips = n_bubbles = 0
    for i in range(conf.max_iterations):
        edges, tips = G.trim_tips(edges, conf)
        edges, bubbles = G.pop_bubbles(G.materialize(edges), conf)
        edges = G.materialize(edges)
        more = (tips.count(), bubbles.count())
        n_tips, n_bubbles = n_tips + more[0], n_bubbles + more[1]
        if more == (0, 0):
            break
    assert found == rows(edges)
    assert done == {"tips_removed": n_tips, "bubbles_removed": n_bubbles, "iterations": i + 1} and n_tips and n_bubbles
    assert jobs < 250, jobs


def test_trails_are_the_chains_of_pairs(spark):
    edges = random_edges()
    by = {}
    for r in G.trails(frame(spark, edges)).collect():
        by.setdefault(r["trail"], []).append((r["rank"], (r["src"], r["dst"])))
    assert sorted([e for _, e in sorted(t)] for t in by.values()) == paired(edges)


def test_components_move_ends_of_pieces_only(spark, monkeypatch):
    edges = {(i, i + 1): 1 for i in range(300)} | {(i, i + 1): 1 for i in range(500, 520)} | {(i, (i + 1) if i < 708 else 700): 1 for i in range(700, 709)} | {(900, 900): 1, (10, 250): 1}
    counted, whole = [], P.connected_components
    monkeypatch.setattr(P, "connected_components", lambda e, a, b: counted.append(e.count()) or whole(e, a, b))
    got = {r["id"]: r["component"] for r in G.components(frame(spark, edges)).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 500 for i in range(500, 521)} | {i: 700 for i in range(700, 709)} | {900: 900}
    assert counted[0] < len(edges) / 3


def _sequences(k, rng):
    base = "".join(rng.choice("ATCG") for _ in range(300))
    cuts = [(rng.randrange(300), rng.choice([0, 1, k - 2, k - 1, k, k + 1, 60, 200])) for _ in range(20)]
    return [base[a : a + n] for a, n in cuts] + ["A" * 70, "", None]


def _counted_ends(texts, k, least):
    code = lambda w: sum("ATCG".index(c) << 2 * (len(w) - 1 - i) for i, c in enumerate(w))
    n = {}
    for w in (t[i : i + k] for t in texts if t for i in range(len(t) - k + 1)):
        n[w] = n.get(w, 0) + 1
    edges = [(code(w[:-1]), code(w[1:]), c) for w, c in n.items() if c >= least]
    return sorted([(a, b, True, c) for a, b, c in edges] + [(b, a, False, c) for a, b, c in edges])


@pytest.mark.parametrize("k", [3, 11, 12, 31])
def test_runs_of_bases_hold_every_kmer_as_often_as_the_reads(k, monkeypatch):
    rng = random.Random(k)
    for buckets, run, bases, counted in ((1, 4096, 1 << 20, 1 << 20), (3, 1, 50, 40), (16, 5, 200, 40), (1024, 4096, 1 << 20, 1 << 20)):
        for name, value in (("BUCKETS", buckets), ("RUN", run), ("SLICE_BASES", bases), ("COUNTED", counted)):
            monkeypatch.setattr(P, name, value)
        texts = _sequences(k, rng)
        read = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["s"]) for x in (texts[:7], texts[7:])]
        rows = sorted((tuple(r.values()) for b in P._runs(k)(iter(read)) for r in b.to_pylist()), key=lambda r: r[0])
        kinds = (pa.int32(), pa.binary(), pa.binary())
        dealt = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "sizes", "bases"])
        for least in (1, 2):
            found = [tuple(r.values()) for b in P._counted(k, least)(dealt.slice(i, 3) for i in range(0, len(rows), 3)) for r in b.to_pylist()]
            assert sorted(found) == _counted_ends(texts, k, least)
            nodes = [f[0] for f in found]
            assert 1 + sum(a != b for a, b in zip(nodes, nodes[1:])) == len(set(nodes))


def test_pieces_of_reads_exchange_few_bytes(spark):
    rng = random.Random(3)
    texts = _sequences(31, rng)
    reads = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "read_id long, sequence string")
    assert rows(P.Pieces.of_reads(reads, 31, 2).edges()) == rows(G.build(reads, 31, 2))
    long = pa.RecordBatch.from_arrays([pa.array(["".join(rng.choice("ATCG") for _ in range(200_000))])], names=["s"])
    sent = sum(len(x) for b in P._runs(31)(iter([long])) for c in ("sizes", "bases") for x in b.column(c).to_pylist())
    assert sent < 2 * 200_000, sent  # k-mers with counts and both ends of each edge were 24 and 96 bytes a base before they were compressed
