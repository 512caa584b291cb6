"""Embedding near-duplicates with robust-pruned flat graphs on overlapping cluster shards.

Vectors are scaled to unit length in double precision; equal ones form a class. A bounded
sample of `n / PER_CLUSTER` vectors (at most `MAX_CLUSTERS`) serves as cluster centres, so
dense regions get many. Then
 * a vector within half the threshold angle of its nearest centre is *tight*: the tight
   vectors of a centre all link with each other, and by the triangle inequality most
   vectors link with all of them or none; only undecided pairs of a vector and a ball are
   compared one by one. Groups of copies are counted this way, never paired;
 * the other vectors go to the shards of their `OVERLAP` nearest centres. A shard builds a
   graph by robust pruning; the adjacency lists of a vector's shards are united; then every
   vector of a shard searches from the shard's medoid, greedily over `BEAM` expansions and
   on through every vector in range;
 * what balls and searches link is followed across shards: linked vectors form groups
   (connected components), and the loose vectors of a group are compared pair by pair, so a
   group that is spread over many shards loses no link;
 * a sample of loose vectors is compared with all rows, half of them such as a bucket of equal
   signs has shown to have a link, so that rare links are audited too. While less than `RECALL`
   of its links are found, the overlap grows, in the end until all loose vectors are one group.
   A sample without links is reported as not measured.
Every link counted is checked in double precision. `audit_recall` measures recall against
brute force from outside. Shards, groups and balls beyond their rows are grids of cells.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; vectors of different lengths do not link; equal vec_ids are separate vectors
of one id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.plans.components import connected_components
from strandflow.session import materialize

THRESHOLD = 0.9
PER_CLUSTER = 250
LEAST_CLUSTERS, MAX_CLUSTERS = 16, 2048
OVERLAP = 3
DEGREE = 16
POOL = 64
ALPHA = 1.2
BEAM = 32
CELL_ROWS = 3000
#: Rows of a cell of a group, and of the tiles in which its pairs are compared.
GROUP_ROWS = 6000
TILE = 256
#: Share of the links of `AUDIT` sampled vectors that must be found, or the overlap grows.
RECALL = 0.9
AUDIT = 1000
#: Tables of sign buckets in which the audit looks for linked vectors.
TABLES = 8
#: Up to so many vectors for each shard of a vector, comparing all pairs costs less than the shards.
EXHAUSTIVE = 30000
#: Margin of decisions by angles; closer ones are compared exactly.
SLACK = 1e-7


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of doubles; null where a vector cannot link."""
    for batch in batches:
        out = []
        for v in batch.column("embedding"):
            v = v.as_py()
            unit = None
            if v and None not in v:
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if np.isfinite(x).all() and top > 0:
                    x = x / top
                    unit = (x / np.sqrt((x * x).sum()) + 0.0).tobytes()
            out.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "unit"])


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


_ASSIGNED = "rep long, unit binary, weight long, home int, cosine double, tight boolean, cells array<int>"


def _assign(centres, threshold: float, overlap: int):
    half = math.acos(threshold) / 2 - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _matrix(batch.column("unit")) @ c.T
            cells = np.argpartition(-near, overlap - 1, axis=1)[:, :overlap]
            home = near.argmax(1)
            best = near[np.arange(len(home)), home]
            tight = _angle(best) <= half
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("rep", "unit", "weight")), pa.array(home.astype(np.int32)), pa.array(best), pa.array(tight), pa.array(np.sort(cells, 1).astype(np.int32).tolist(), pa.list_(pa.int32()))],
                names=["rep", "unit", "weight", "home", "cosine", "tight", "cells"],
            )

    return run


def _against_balls(centres, balls, threshold: float):
    """Counts (n), edges (e), weight for a ball's members (w) and undecided vector-ball pairs (r)."""
    reach = math.acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weight, radius, rep = balls.value
        for batch in batches:
            if not batch.num_rows or not len(number):
                continue
            angle = _angle(_matrix(batch.column("unit")) @ centres.value[number].T)
            full = angle + radius <= reach - SLACK
            maybe = ~full & (angle - radius <= reach + SLACK)
            ids, own = batch.column("rep").to_numpy(), batch.column("weight").to_numpy()
            tight, home = batch.column("tight").to_numpy(zero_copy_only=False), batch.column("home").to_numpy()
            inside = tight[:, None] & (home[:, None] == number[None, :])
            full, maybe = full | inside, maybe & ~inside
            count = full @ weight - np.where(tight, own, 0)
            some = np.flatnonzero(count)
            rows = [("n", ids[some], count[some])]
            first = np.where(full.any(1), rep[full.argmax(1)], 0)
            linked = np.flatnonzero(full.any(1))
            rows.append(("e", ids[linked], first[linked]))
            joint = np.unique(full[linked], axis=0) if len(linked) else full[:0]
            a, b = np.nonzero(joint)
            rows.append(("e", rep[b], rep[joint.argmax(1)[a]] if len(joint) else rep[b]))
            loose = ~tight
            extra = own[loose] @ full[loose] if loose.any() else np.zeros(len(number), np.int64)
            rows.append(("w", number[extra > 0].astype(np.int64), extra[extra > 0]))
            i, j = np.nonzero(maybe)
            rows.append(("r", ids[i], number[j].astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([k for k, _, _ in rows], [len(x) for _, x, _ in rows]), pa.string()), pa.array(np.concatenate([x for _, x, _ in rows]).astype(np.int64)), pa.array(np.concatenate([y for _, _, y in rows]).astype(np.int64))],
                names=["kind", "a", "b"],
            )

    return run


def _check_ball(threshold: float):
    def run(key, queries: pa.Table, members: pa.Table) -> pa.Table:
        kinds, a, b = [], [], []
        if queries.num_rows and members.num_rows:
            q, m = _matrix(queries.column("unit")), _matrix(members.column("unit"))
            q_id, m_id = queries.column("rep").to_numpy(), members.column("rep").to_numpy()
            q_w, m_w = queries.column("weight").to_numpy(), members.column("weight").to_numpy()
            loose = ~queries.column("tight").to_numpy()
            back = np.zeros(len(m), np.int64)
            for at in range(0, len(q), 1024):
                hit = q[at : at + 1024] @ m.T >= threshold
                part = slice(at, at + 1024)
                n = hit @ m_w
                some = np.flatnonzero(n)
                kinds += ["n"] * len(some) + ["e"] * len(some)
                a += [q_id[part][some], q_id[part][some]]
                b += [n[some], m_id[hit[some].argmax(1)]]
                back += (q_w[part] * loose[part]) @ hit
            some = np.flatnonzero(back)
            kinds += ["n"] * len(some)
            a.append(m_id[some])
            b.append(back[some])
        return pa.table({"kind": pa.array(kinds, pa.string()), "a": pa.array(np.concatenate(a) if a else [], pa.int64()), "b": pa.array(np.concatenate(b) if b else [], pa.int64())})

    return run


def robust_prune(x: np.ndarray, i: int, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Neighbours of i from a pool sorted by similarity; one goes if a chosen one is nearer to it by `alpha` than i is."""
    distance = np.maximum(2 - 2 * (x[pool] @ x[i]), 0)
    alive = np.ones(len(pool), bool)
    out = []
    while len(out) < degree:
        left = np.flatnonzero(alive)
        if not len(left):
            break
        p = left[0]
        out.append(int(pool[p]))
        between = np.maximum(2 - 2 * (x[pool] @ x[pool[p]]), 0)
        alive &= alpha * alpha * between > distance
        alive[p] = False
    return out


def build_graph(x: np.ndarray) -> list[list[int]]:
    """Adjacency lists of a shard: robust-pruned nearest candidates, their reverses, and a path through all.

    The candidates are each vector's `POOL` nearest and some far ones, as a shard is small.
    """
    m = len(x)
    near: list[list[int]] = []
    rng = np.random.default_rng(m)
    far = rng.integers(0, m, (m, 8))
    for at in range(0, m, 512):
        s = x[at : at + 512] @ x.T
        k = min(POOL, m)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        for r in range(len(s)):
            i = at + r
            pool = np.unique(np.concatenate([top[r], far[i]]))
            pool = pool[pool != i]
            near.append(robust_prune(x, i, pool[np.argsort(-s[r, pool], kind="stable")]))
    back: list[list[int]] = [[] for _ in range(m)]
    for i, out in enumerate(near):
        for j in out:
            back[j].append(i)
    lists = []
    for i in range(m):
        own = list(dict.fromkeys([*near[i], *back[i]]))
        if len(own) > 2 * DEGREE:
            pool = np.array(own)
            own = robust_prune(x, i, pool[np.argsort(-(x[pool] @ x[i]), kind="stable")], 2 * DEGREE)
        lists.append(list(dict.fromkeys([*own, (i + 1) % m])) if m > 1 else [])
    return lists


def range_search(x: np.ndarray, lists: list[list[int]], start: int, threshold: float) -> np.ndarray:
    """Boolean matrix: which vectors each vector's search found in range (itself included)."""
    m = len(x)
    width = max(map(len, lists), default=1) or 1
    table = np.full((m, width), -1)
    for i, l in enumerate(lists):
        table[i, : len(l)] = l
    out = np.zeros((m, m), bool)
    for at in range(0, m, 1024):
        q = x[at : at + 1024]
        seen = np.full((len(q), m), -2.0, np.float64)
        waiting = np.full((len(q), m), -2.0, np.float64)
        first = q @ x[start]
        seen[:, start] = waiting[:, start] = first
        spent = np.zeros(len(q), np.int64)
        active = np.arange(len(q))
        while len(active):
            best = waiting[active].argmax(1)
            value = waiting[active, best]
            spent[active] += value < threshold
            go = (value > -2) & ((value >= threshold) | (spent[active] <= BEAM))
            active, best = active[go], best[go]
            if not len(active):
                break
            waiting[active, best] = -2.0
            nb = table[best]
            r, c = np.nonzero(nb >= 0)
            who, to = active[r], nb[r, c]
            new = seen[who, to] == -2.0
            who, to = who[new], to[new]
            s = np.einsum("ij,ij->i", q[who], x[to])
            seen[who, to] = s
            waiting[who, to] = s
        out[at : at + len(q)] = seen >= threshold
    return out


def _shard_graph(table: pa.Table) -> pa.Table:
    x, ids = _matrix(table.column("unit")), table.column("rep").to_numpy()
    lists = build_graph(x)
    return pa.table({"rep": pa.array(ids), "near": pa.array([ids[l].tolist() for l in lists], pa.list_(pa.int64()))})


def _shard_search(threshold: float):
    """Edges (a, b) that join what the searches of a shard find in range of each other."""

    def run(table: pa.Table) -> pa.Table:
        x, ids = _matrix(table.column("unit")), table.column("rep").to_numpy()
        number = {i: k for k, i in enumerate(ids.tolist())}
        lists = [[number[j] for j in l if j in number] for l in table.column("near").to_pylist()]
        medoid = int((x @ x.mean(0)).argmax())
        found = range_search(x, lists, medoid, threshold)
        found |= found.T
        root = np.full(len(x), -1)
        for i in range(len(x)):
            if root[i] < 0:
                root[i], todo = i, [i]
                while todo:
                    new = np.flatnonzero(found[todo.pop()] & (root < 0))
                    root[new] = i
                    todo += new.tolist()
        some = np.flatnonzero(root != np.arange(len(x)))
        return pa.table({"a": pa.array(ids[some]), "b": pa.array(ids[root[some]])})

    return run


def _group_links(threshold: float):
    """Links between the vectors of a cell of a group, every pair compared: counts (n) and edges that span them (e)."""

    def run(table: pa.Table) -> pa.Table:
        x, ids, weight = _matrix(table.column("unit")), table.column("rep").to_numpy(), table.column("weight").to_numpy()
        side = table.column("side").to_numpy()
        n = np.where(side == 2, -weight, 0)
        root = np.arange(len(x))
        for own, other in ((2, 2), (0, 1), (1, 0)):
            rows, to = np.flatnonzero(side == own), np.flatnonzero(side == other)
            y, w = x[to], weight[to].astype(np.float64)
            for at in range(0, len(rows), TILE):
                part = rows[at : at + TILE]
                hit = x[part] @ y.T >= threshold
                if own == 2:
                    hit[np.arange(len(part)), at + np.arange(len(part))] = True  # a vector is counted, and taken off above
                n[part] += np.rint(hit @ w).astype(np.int64)
                for r, i in enumerate(part.tolist() if own != 1 else []):
                    met = root[to[hit[r]]]
                    if (met != root[i]).any():
                        met = np.unique(np.append(met, root[i]))
                        root[np.isin(root, met)] = met[0]
        some, far = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(x)))
        return pa.table({
            "kind": pa.array(["n"] * len(some) + ["e"] * len(far), pa.string()),
            "a": pa.array(np.concatenate([ids[some], ids[far]])),
            "b": pa.array(np.concatenate([n[some], ids[root[far]]])),
        })

    return run


def _hashes(width: int, bits: int):
    """(rep, place, bucket) of each vector in `TABLES` tables: signs of its products with random directions."""
    planes = np.random.default_rng(1).normal(size=(width, TABLES * bits))
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signs = (_matrix(batch.column("unit")) @ planes > 0).reshape(batch.num_rows, TABLES, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column("rep").to_numpy(), TABLES)), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), batch.num_rows)), pa.array((signs @ powers).reshape(-1))],
                    names=["rep", "place", "bucket"])

    return run


def _linked_sample(assigned: DataFrame, threshold: float) -> DataFrame:
    """(rep) of loose classes with a link that was found without shards: of vectors whose signs agree, two of each bucket are compared.

    Buckets get finer with the table, and a bucket of any size gives one pair.
    """
    loose = assigned.where("NOT tight").select("rep", "unit")
    width, n = loose.agg(F.max(F.octet_length("unit")), F.count("*")).first()
    if not n:
        return loose.select("rep")
    bits = min(48, max(12, math.ceil(math.log2(n)) + 2))
    hashed = loose.mapInArrow(_hashes(width // 8, bits), "rep long, place int, bucket long")
    pairs = hashed.groupBy("place", "bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b").distinct()
    both = pairs.join(loose.select(F.col("rep").alias("a"), F.col("unit").alias("x")), "a").join(loose.select(F.col("rep").alias("b"), F.col("unit").alias("y")), "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hit = np.flatnonzero((_matrix(batch.column("x")) * _matrix(batch.column("y"))).sum(1) >= threshold)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column("a").take(pa.array(hit)), batch.column("b").take(pa.array(hit))])], names=["rep"])

    return both.select("a", "b", "x", "y").mapInArrow(close, "rep long").distinct()


def _audit_sample(assigned: DataFrame, threshold: float) -> dict[int, int]:
    """True links (weights of other classes in range) of at most `AUDIT` loose classes, by brute force over all classes.

    At most half of them are known to have a link, so that a table with few links is audited by those; the others are any.
    """
    linked = materialize(_linked_sample(assigned, threshold), "ann-linked").orderBy(F.xxhash64("rep", F.lit("audit"))).limit(AUDIT // 2)
    some = assigned.where("NOT tight").join(F.broadcast(linked), "rep", "left_semi").select("rep", "unit", "weight").collect()  # AUDIT / 2 rows at most
    known = [r["rep"] for r in some]
    some += assigned.where("NOT tight").where(~F.col("rep").isin(known)).orderBy(F.xxhash64("rep", F.lit("audit"))).select("rep", "unit", "weight").limit(AUDIT - len(some)).collect()
    if not some:
        return {}
    shared = assigned.sparkSession.sparkContext.broadcast(b"".join(bytes(r["unit"]) for r in some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.frombuffer(shared.value, np.float64).reshape(len(some), -1)
        n = np.zeros(len(q))
        for batch in batches:
            if batch.num_rows:
                n += (q @ _matrix(batch.column("unit")).T >= threshold) @ batch.column("weight").to_numpy().astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(np.rint(n).astype(np.int64))], names=["k", "n"])

    some = [(r["rep"], r["weight"]) for r in some]
    found = assigned.select("unit", "weight").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {some[r["k"]][0]: r["n"] - some[r["k"]][1] for r in found}


def _recall(sample: dict[int, int], counts: DataFrame) -> float | None:
    """The lesser of the share of all links of the sample that were found and the mean share of a vector's own; None where it has none."""
    true = {rep: n for rep, n in sample.items() if n > 0}
    if not true:
        return None
    got = dict(counts.where(F.col("rep").isin(list(true))).select("rep", "n").collect())
    have = {rep: min(got.get(rep, 0), n) for rep, n in true.items()}
    return min(sum(have.values()) / sum(true.values()), sum(have[rep] / n for rep, n in true.items()) / len(true))


def _shard_edges(assigned: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) between loose vectors that searches of the shards found."""
    dealt = _cells(assigned.where("NOT tight").select("rep", "unit", F.explode("cells").alias("cell")), "cell", CELL_ROWS)
    lists = dealt.groupBy("cell", "i", "j").applyInArrow(_shard_graph, "rep long, near array<long>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return dealt.join(united, "rep").groupBy("cell", "i", "j").applyInArrow(_shard_search(threshold), "a long, b long")


def _cells(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Deal rows of each key to the cells (i, j) of its grid; side 2 compares with all, 0 with 1."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("m"))
    wide = sizes.where(F.col("m") > most).select(key, F.ceil(F.col("m") / most).cast("int").alias("grid"))
    mine = F.pmod(F.xxhash64("rep"), F.col("grid")).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.col("grid") - 1), lambda k: F.struct(
        F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j"), F.when(k == mine, 2).when(mine < k, 0).otherwise(1).alias("side")))
    grid = rows.join(wide, key, "left").withColumn("grid", F.coalesce("grid", F.lit(1)))
    return grid.withColumn("place", F.explode(places)).select("*", "place.i", "place.j", "place.side").drop("place", "grid")


def _of_length(units: DataFrame, threshold: float, figures: list | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For unit vectors of one length: (vec_id, rep, weight), counts (rep, n), edges."""
    sc = units.sparkSession.sparkContext
    classes = materialize(units.groupBy("unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "ann-classes")
    n = classes.count()
    k = min(n, MAX_CLUSTERS, max(LEAST_CLUSTERS, round(n / PER_CLUSTER)))
    sample = sorted(bytes(r[0]) for r in classes.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(k).collect())
    centres = np.frombuffer(b"".join(sample), np.float64).reshape(len(sample), -1)
    shared = sc.broadcast(centres)  # at most MAX_CLUSTERS vectors
    overlap = min(OVERLAP, len(centres))
    assigned = materialize(classes.mapInArrow(_assign(shared, threshold, overlap), _ASSIGNED), "ann-assigned")

    found = assigned.where("tight").groupBy("home").agg(F.sum("weight"), F.min("cosine"), F.min("rep")).collect()  # a row for each centre at most
    balls = (np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64), _angle(np.array([r[2] for r in found])), np.array([r[3] for r in found], np.int64))
    decided = materialize(assigned.mapInArrow(_against_balls(shared, sc.broadcast(balls), threshold), "kind string, a long, b long"), "ann-balls")
    extra = decided.where("kind = 'w'").groupBy(F.col("a").cast("int").alias("home")).agg(F.sum("b").alias("n"))
    for_members = assigned.where("tight").join(F.broadcast(extra), "home").select("rep", "n")

    # a grid of cells for each ball: members and queries are dealt to its two sides
    routed = decided.where("kind = 'r'").select(F.col("a").alias("rep"), F.col("b").cast("int").alias("ball"))
    side = lambda rows, name: rows.groupBy("ball").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(name))
    balled = assigned.where("tight").select(F.col("home").alias("ball"), "rep", "unit", "weight")
    sizes = side(balled, "m_cells").join(side(routed, "q_cells"), "ball")
    dealt = lambda cells: F.pmod(F.xxhash64("rep"), F.col(cells)).cast("int")
    every = lambda cells: F.explode(F.sequence(F.lit(0), F.col(cells) - 1))
    members = balled.join(sizes, "ball").withColumn("m_cell", dealt("m_cells")).withColumn("q_cell", every("q_cells"))
    queries = routed.join(sizes, "ball").withColumn("q_cell", dealt("q_cells")).withColumn("m_cell", every("m_cells"))
    queries = queries.join(assigned.select("rep", "unit", "weight", "tight"), "rep")
    cell = ["ball", "m_cell", "q_cell"]
    checked = queries.select(*cell, "rep", "unit", "weight", "tight").groupBy(*cell).cogroup(members.select(*cell, "rep", "unit", "weight").groupBy(*cell)).applyInArrow(_check_ball(threshold), "kind string, a long, b long")

    by_balls = materialize(decided.where("kind IN ('n', 'e')").unionByName(checked), "ann-balls-found")
    exact = by_balls.where("kind = 'n'").select(F.col("a").alias("rep"), F.col("b").alias("n")).unionByName(for_members)
    edges = by_balls.where("kind = 'e'").select("a", "b")
    loose = assigned.where("NOT tight").select("rep", "unit", "weight")
    sample = _audit_sample(assigned, threshold)
    while True:
        whole = overlap >= len(centres)
        if whole:
            grouped = loose.withColumn("grp", F.lit(0).cast("long"))
        else:
            edges = materialize(edges.unionByName(_shard_edges(assigned, threshold)), "ann-edges")
            groups = connected_components(edges, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("grp"))
            grouped = loose.join(groups, "rep")
        within = _cells(grouped, "grp", GROUP_ROWS).groupBy("grp", "i", "j").applyInArrow(_group_links(threshold), "kind string, a long, b long")
        within = materialize(within, "ann-links")
        found = within.where("kind = 'n'").select(F.col("a").alias("rep"), F.col("b").alias("n"))
        counts = materialize(exact.unionByName(found).groupBy("rep").agg(F.sum("n").alias("n")), "ann-counts")
        share = 1.0 if whole else _recall(sample, counts)
        if figures is not None:
            figures.append({"vectors": n, "overlap": overlap, "exhaustive": whole, "audited_links": sum(sample.values()), "recall": share})
        # no link among the sample, nor between any two vectors of a bucket: nothing to be measured
        if share is None or share >= RECALL:
            break
        overlap = min(OVERLAP * overlap, len(centres))
        if n <= EXHAUSTIVE * overlap:
            overlap = len(centres)
        if overlap < len(centres):
            assigned = materialize(classes.mapInArrow(_assign(shared, threshold, overlap), _ASSIGNED), "ann-assigned")
    edges = edges.unionByName(within.where("kind = 'e'").select("a", "b")).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return units.join(classes, "unit").select("vec_id", "rep", "weight"), counts, edges


def link_embeddings(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, figures: list | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    `figures` gets a dict for every search: vectors, overlap, whether all were compared, the links audited, and their recall (None if there were none).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    units = materialize(rows.mapInArrow(_units, "vec_id long, unit binary"), "ann-units")
    valid = units.where("unit IS NOT NULL AND vec_id IS NOT NULL")
    lengths = sorted(r[0] for r in valid.select(F.octet_length("unit")).distinct().collect())
    out = units.where("unit IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for length in lengths:
        named, counts, edges = _of_length(valid.where(F.octet_length("unit") == length), threshold, figures)
        components = connected_components(edges).withColumnRenamed("node", "rep")
        joined = named.join(counts, "rep", "left").join(components, "rep", "left")
        out = out.unionByName(joined.select(
            "vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit_recall(vectors: DataFrame, linked: DataFrame, *, sample: int = 200, threshold: float = THRESHOLD) -> float:
    """Links that `linked` has of those that brute force finds for a sample of the valid vectors of the commonest length.

    The sample, of bounded size, is broadcast and compared with all rows, block by block.
    """
    units = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_units, "vec_id long, unit binary").where("unit IS NOT NULL")
    common = units.groupBy(F.octet_length("unit").alias("length")).count().orderBy(F.desc("count"), "length").first()
    units = units.where(F.octet_length("unit") == (common[0] if common else 0))
    queries = {r[0]: bytes(r[1]) for r in units.orderBy(F.xxhash64("vec_id", F.lit("audit")), "vec_id").limit(sample).collect()}
    if not queries:
        return 1.0
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.frombuffer(b"".join(shared.value.values()), np.float64).reshape(len(shared.value), -1)
        for batch in batches:
            hit = q @ _matrix(batch.column("unit")).T >= threshold if batch.num_rows else np.zeros((len(q), 0), bool)
            yield pa.RecordBatch.from_arrays([pa.array(list(shared.value), pa.int64()), pa.array(hit.sum(1).astype(np.int64))], names=["vec_id", "n"])

    true = units.mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("true"))
    total, got = true.join(linked, "vec_id").agg(F.sum("true"), F.sum(F.least("true", "n_links"))).first()
    return got / total if total else 1.0


def digest(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    return link_embeddings(vectors)


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE array_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
