"""Merkle manifest, centroid clustering and nearest neighbours against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm import blocknorm, hilbert, merkle

# ---- Merkle manifest ----


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Levels from the nodes up to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        out.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        at //= 16
    return out


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    top = tree([trees[s][-1][0] for s in sources])
    root = top[-1][0]
    out = []
    for k, s in enumerate(sources):
        for at, r in enumerate(by[s]):
            proof = path(trees[s], at) + path(top, k)
            folded = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                folded = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for before, after in proof:
                folded = h(before + folded + after)
            out.append((r[0], leaf(r), trees[s][-1][0], root, h("".join(b + a for b, a in proof)), folded, folded == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars int, text string, digest string, pos long, key string"


def manifest_of(spark, rows):
    return sorted(map(tuple, merkle.digest(spark.createDataFrame([(*r, "x", 7, "y") for r in rows], DOCS)).collect()), key=str)


def test_manifest(spark):
    rng = random.Random(3)
    rows = [(i, "hot", "en", 5, f"Text {rng.random()} ÄÖ") for i in range(300)]
    rows += [(1000 + i, f"s{i}", None, None, None if i % 3 else "") for i in range(40)]  # more sources than a run holds
    rows += [(2000 + i, None, "de", i, "A" * 20000) for i in range(17)]
    rows += [(5, "hot", "en", 5, "again the id"), (None, "hot", None, None, None), (-4, "é", "", 0, "x"), (7, "", "", 0, "Y")]
    rows += [(9, "same", "en", 1, "A row")] * 20
    rng.shuffle(rows)
    got = manifest_of(spark, rows)
    assert got == brute_manifest(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 17, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert manifest_of(spark, rows) == (brute_manifest(rows) if n else [])


def test_proofs_tell_any_change(spark):
    rows = [(f"k{i % 3}", i, h(str(i))) for i in range(100)]
    proofs = merkle.manifest(spark.createDataFrame(rows, "key string, id long, digest string"))
    right = merkle.fold(F.col("digest"), F.col("proof")) == F.col("root")
    wrong = merkle.fold(F.sha2("digest", 256), F.col("proof")) == F.col("root")
    assert [tuple(r) for r in proofs.select(right, wrong).distinct().collect()] == [(True, False)]


# ---- centroid clustering ----


def brute_clusters(rows, k=16, rounds=3, length=64):
    kept = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == length and None not in v and np.isfinite(v).all()]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), tuple(r[1])))[:k]
    c = [r[1] for r in start]
    place = lambda x: min((int(((x - m) ** 2).sum()), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [place(x)[1] for _, x in kept]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            if mine:
                c[j] = np.sum(mine, axis=0) // len(mine)
    out = [(i, *place(x)) for i, x in kept]
    inertia = [sum(d for _, d, o in out if o == j) for j in range(len(c))]
    return sorted([(i, o, d, inertia[o], sum(inertia), h(",".join(map(str, c[o])))) for i, d, o in out], key=str)


VECTORS = "vec_id long, embedding array<float>, cluster int, x string, label int"


def test_centroids(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(200, 64)) / 8)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)] + [(4, rows[9][1])] * 3  # copies, an id four times
    rows += [(5000, None), (5001, []), (5002, [0.5] * 63), (5003, [None] + [0.1] * 63), (5004, [float("nan")] * 64), (5005, [float("inf")] * 64), (5006, [0.0] * 64), (None, [0.3] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)
    got = sorted(map(tuple, blocknorm.digest(df).collect()), key=str)
    assert got == brute_clusters([(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_few_or_no_vectors(spark):
    assert blocknorm.digest(spark.createDataFrame([], VECTORS)).count() == 0
    assert blocknorm.digest(spark.createDataFrame([(1, [0.5] * 3, 1, "x", 2)], VECTORS)).count() == 0
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted(map(tuple, blocknorm.digest(spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)).collect()), key=str) == brute_clusters(rows)
    with pytest.raises(Exception, match="beyond"):
        blocknorm.digest(spark.createDataFrame([(1, [1e30] * 64, 1, "x", 2)], VECTORS)).collect()


def test_norms_screen_most_centroids_of_blocked_vectors(spark):
    rng = np.random.default_rng(5)
    x = 0.02 * rng.normal(size=(600, 64))
    for i in range(600):
        x[i, 8 * (i % 8) : 8 * (i % 8) + 8] += 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    told = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    blocknorm.cluster_vectors(df, clusters=8, figures=told)[0].count()
    assert all(t["rows"] == 600 for t in told) and told[-1]["measured"] < 0.5 * 600 * 8
    assert told[0]["inertia"] >= told[-1]["inertia"]


def test_screening_keeps_ties_and_nearest():
    rng = np.random.default_rng(8)
    for scale in (1, 30, 1 << 20):
        x, c = rng.integers(-2 * scale, 2 * scale + 1, (300, 64)), rng.integers(-2 * scale, 2 * scale + 1, (16, 64))
        c[9] = c[2]
        x[:5] = c[2]
        x[5] = 0
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        cluster, distance, measured = blocknorm.nearest(x, blocknorm.segment_norms(x, blocknorm.SEGMENT), (x * x).sum(1), c)
        assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all() and measured <= d.size


# ---- nearest neighbours ----


def sum_of(v, w):
    total = 0.0
    for x, y in zip(v, w):  # one after the other; sum() of newer Pythons adds floats otherwise
        total += float(x) * float(y)
    return total


def brute_nearest(rows, top=20):
    good = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for k, i, v in good:
        if i is not None and i % 20 == 0:
            near = sorted((-sum_of(v, w), j is None, j or 0, m) for m, j, w in good if m != k and len(w) == len(v))[:top]
            out += [(i, r + 1, None if n else j, -s) for r, (s, n, j, _) in enumerate(near)]
    return sorted(out, key=str)


def nearest_of(spark, rows, kind="double", **options):
    df = spark.createDataFrame([(i, v, 3, "x", 0.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int, cls string, score double")
    return hilbert.nearest_neighbours(df, F.col("vec_id") % 20 == 0, **options)


def test_nearest_in_blocks(spark):
    """Every block is searched in the end: exact with copies, ties, repeated ids and other lengths."""
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 16)) * rng.uniform(0.2, 3, (300, 1)))]
    rows += [(1000 + i, rows[40][1]) for i in range(150)]  # copies of a query, queries among them
    rows += [(60, rows[61][1]), (60, rows[60][1]), (None, rows[20][1]), (None, rows[20][1]), (2000, [1.0, 2.0]), (2001, [3.0, 1.0]), (2020, [5.0])]
    rows += [(4000, None), (4020, []), (4040, [0.0] * 16), (4060, [None] * 16), (4080, [float("nan")] * 16), (4100, [float("-inf")] * 16)]
    told = []
    got = sorted(map(tuple, nearest_of(spark, rows, block=32, recall=1.1, figures=told).collect()), key=str)
    assert got == brute_nearest(rows) and len(told) > 2
    assert any(r[0] == 2000 for r in got) and not any(r[0] == 2020 for r in got)


def test_nearest_follows_the_curves(spark):
    """Clustered vectors: a small window of short blocks reaches the recall asked for."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(80, 32)), 50, 0) + 0.15 * rng.normal(size=(4000, 32))
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(x[rng.permutation(4000)])]
    told = []
    got = nearest_of(spark, rows, "float", block=100, figures=told).collect()
    true = {(r[0], r[2]) for r in brute_nearest(rows)}
    assert len(got) == 4000 and all(r["rank"] <= 20 for r in got)
    assert len(true & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(true)
    assert told[-1]["window"] < told[-1]["blocks"] / 4  # most blocks were never searched
    by = dict(rows)
    assert all(r["score"] == sum_of(by[r["query_id"]], by[r["vec_id"]]) for r in got)


def test_no_or_few_rows(spark):
    assert nearest_of(spark, []).count() == 0
    assert nearest_of(spark, [(20, [1.0, 0.0])]).count() == 0
    assert nearest_of(spark, [(21, [1.0, 0.0]), (22, [1.0, 1.0])]).count() == 0
    assert [tuple(r) for r in nearest_of(spark, [(20, [1.0, 0.0]), (22, [-1.0, 1.0])]).collect()] == [(20, 1, 22, -1.0)]


def test_curve_steps_are_neighbours():
    for dimensions, bits in ((2, 4), (3, 3), (6, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
        keys = hilbert.hilbert_keys(grid, bits)
        assert (np.sort(keys) == np.arange(len(grid))).all()
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()
