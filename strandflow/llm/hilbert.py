"""Nearest neighbours by inner product from shifted space-filling curves.

Different vectors form classes, of which one entry is indexed: with the `top` + 1 members that can
be reported at all, those of smallest id. Inner product becomes nearness on a sphere: a class is
scaled by the greatest norm and takes one more component that brings it to length 1; a query's
is 0. For each of `CURVES` curves the classes are projected on `DIMENSIONS` directions, fitted to at
most `FIT` of them (the principal ones, then mixtures of the first few), shifted, cut to a grid and
numbered along a Hilbert curve. All classes are then ranked by key in Spark, and `BLOCK` consecutive
ones make a block. A query is compared with the blocks whose keys neighbour its own, up to `window`
to each side, in cells of one block and the queries of `SPAN` blocks; a cell keeps the best `top` + 1
of a query, and what the curves found is merged and ranked again.

The first window is `WINDOW` blocks. After each, `AUDIT` query classes are compared with every class;
while the share of their true neighbours that were found is below `RECALL`, the window is doubled
and only its new blocks are searched. Where curves tell nothing (random vectors in many dimensions)
it goes on until every block has been searched: then the result is exact and the audit no longer asked.

Scores are sums in double precision over the original components, added from the first to the last,
so equal vectors tie, and ties go to the smaller id.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part;
vectors of different lengths are searched apart; a row whose id is null is no query but is found,
after others of its score; rows of one id are vectors of their own, and only a query's own row
is left out; fewer than `top` other rows are all returned; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.plans.numbering import number_rows
from strandflow.session import materialize

TOP, EVERY = 20, 20
CURVES, DIMENSIONS, BITS = 3, 6, 10
FIT = 4096
BLOCK, SPAN, WINDOW = 1024, 64, 1
#: Share of the true neighbours of `AUDIT` query classes that must be found; above the 0.9 that the whole table must reach.
RECALL, AUDIT = 0.94, 400
#: Queries of a cell that are compared at a time.
ROWS = 256
#: Stands for a null id, which sorts last.
NO_ID = (1 << 63) - 1


def _plain(width: str):
    """Components as bytes of type `width`, and the norm; null where a vector takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, norms = [], []
            for v in batch.column("embedding").to_pylist():
                x = np.array(v, np.float64) + 0.0 if v and None not in v else np.zeros(0)
                good = np.isfinite(x).all() and x.any()
                out.append(x.astype(width).tobytes() if good else None)
                norms.append(float(np.sqrt((x * x).sum())) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "vec", "norm"])

    return run


def _matrix(column, width: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), width).reshape(len(values), len(values[0]) // np.dtype(width).itemsize if values else 0).astype(np.float64)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) with `bits` bits a coordinate, as int64.

    Coordinates are turned to the transposed index, whose bits are interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def fit_curves(sample: np.ndarray, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(directions, lowest, step) of each curve, from a sample of lifted vectors.

    The grid covers twice the sample's range, so that a shift of up to a half leaves it inside.
    """
    rng = np.random.default_rng(0)
    width = sample.shape[1]
    dimensions = min(dimensions, width)
    _, _, axes = np.linalg.svd(sample - sample.mean(0), full_matrices=True)
    out = []
    for c in range(curves):
        if c == 0:
            directions = axes[:dimensions]
        else:
            some = axes[: min(width, 4 * dimensions)]
            directions = np.linalg.qr(rng.normal(size=(len(some), dimensions)))[0].T @ some
        at = sample @ directions.T
        low, high = at.min(0), at.max(0)
        reach = np.maximum(high - low, 1e-12)
        out.append((directions, low - reach * rng.uniform(0, 1, dimensions), 2 * reach / (1 << bits)))
    return out


def _lift(x: np.ndarray, most: float, query: bool) -> np.ndarray:
    """Rows on the unit sphere of one more dimension, where the nearest to a query has the largest inner product with it."""
    norm = np.sqrt((x * x).sum(1))
    if query:
        return np.hstack([x / norm[:, None], np.zeros((len(x), 1))])
    scaled = x / most
    return np.hstack([scaled, np.sqrt(np.maximum(1 - (scaled * scaled).sum(1), 0))[:, None]])


def _keys(model, bits: int, width: str):
    """A key on each curve for every class, and for one that is asked one more of its query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, curves = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), width)
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            for query in (False, True):
                rows = np.flatnonzero(asked) if query else np.arange(len(x))
                lifted = _lift(x[rows], most, query)
                for c, (directions, low, step) in enumerate(curves):
                    cells = np.clip(np.floor((lifted @ directions.T - low) / step), 0, (1 << bits) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), c, np.int32)), pa.array(hilbert_keys(cells, bits)), batch.column("cls").take(pa.array(rows)), pa.array(np.full(len(rows), query))],
                        names=["curve", "key", "cls", "query"])

    return run


def _ranked(i: np.ndarray, first: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` entries of each i, by score and then `first`."""
    order = np.lexsort((first, -score, i))
    sorted_ = i[order]
    return order[np.arange(len(i)) - np.searchsorted(sorted_, sorted_) < top]


def best_of(q: np.ndarray, c: np.ndarray, first: np.ndarray, top: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, score) of the `top` best of c for each row of q, by score and then `first`; none below a query's `least`."""
    rows, columns, scores = [], [], []
    size = np.sqrt((c * c).sum(1)).max(initial=0)
    for at in range(0, len(q), ROWS):
        part = q[at : at + ROWS]
        near = part @ c.T
        k = min(top, len(c))
        worst = np.partition(near, len(c) - k, axis=1)[:, len(c) - k]
        if least is not None:
            worst = np.maximum(worst, least[at : at + ROWS])
        slack = 1e-12 * size * np.sqrt((part * part).sum(1))  # far above the rounding of either sum
        i, j = np.nonzero(near >= (worst - slack)[:, None])
        exact = np.empty(len(i))
        for s in range(0, len(i), 1 << 14):
            some = slice(s, s + (1 << 14))
            exact[some] = np.add.accumulate(part[i[some]] * c[j[some]], axis=1)[:, -1]
        kept = _ranked(i, first[j], exact, top)
        rows.append(i[kept] + at)
        columns.append(j[kept])
        scores.append(exact[kept])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(scores)


_FOUND = "q binary, c binary, first long, score double"


def _found(q_cls, c_cls, first: np.ndarray, q: np.ndarray, c: np.ndarray, top: int, least: np.ndarray) -> pa.Table:
    i, j, score = best_of(q, c, first, top, least) if len(q) and len(c) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"q": q_cls.take(pa.array(i)), "c": c_cls.take(pa.array(j)), "first": pa.array(first[j]), "score": pa.array(score)})


def _cell(top: int, width: str):
    def run(key, queries: pa.Table, block: pa.Table) -> pa.Table:
        first = block.column("first").to_numpy()
        least = queries.column("least").to_numpy()
        return _found(queries.column("cls").combine_chunks(), block.column("cls").combine_chunks(), first, _matrix(queries.column("vec"), width), _matrix(block.column("vec"), width), top, least)

    return run


def _merged(found: DataFrame, top: int) -> DataFrame:
    """The best `top` of each query; a class found on several curves counts once."""
    once = found.groupBy("q", "c").agg(F.first("first").alias("first"), F.first("score").alias("score"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first", "c")))
    return ranked.where(F.col("place") <= top).drop("place")


def _listed(best: DataFrame, classes: DataFrame, top: int) -> DataFrame:
    """(q, list): the `top` nearest rows of each query class, nearest first; its own rows are among them."""
    each = best.join(classes.select(F.col("cls").alias("c"), "members"), "c")
    items = F.transform("members", lambda m: F.struct((-F.col("score")).alias("far"), m["none"].alias("none"), m["vec_id"].alias("vec_id"), m["row"].alias("row")))
    return each.select("q", items.alias("items")).groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("items"))), 1, top).alias("list"))


def _truth(classes: DataFrame, audit: int, top: int, width: str) -> DataFrame | None:
    """What `_listed` should give for at most `audit` query classes, by comparison with every class."""
    some = classes.where("asked").orderBy(F.xxhash64("cls", F.lit("audit")), "cls").select("cls", "vec").limit(audit).collect()
    if not some:
        return None
    shared = classes.sparkSession.sparkContext.broadcast(([bytes(r["cls"]) for r in some], b"".join(bytes(r["vec"]) for r in some)))  # at most `audit` vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, raw = shared.value
        q = np.frombuffer(raw, width).reshape(len(names), -1).astype(np.float64)
        held = (np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            if batch.num_rows:
                first = batch.column("first").to_numpy()
                i, j, score = best_of(q, _matrix(batch.column("vec"), width), first, top)
                both = [np.concatenate(x) for x in zip(held, (i, np.array(batch.column("cls").to_pylist(), object)[j], first[j], score), strict=True)]
                kept = _ranked(both[0], both[2], both[3], top)
                held = tuple(x[kept] for x in both)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[k] for k in held[0]], pa.binary()), pa.array(held[1].tolist(), pa.binary()), pa.array(held[2]), pa.array(held[3])], names=["q", "c", "first", "score"])

    best = _merged(classes.select("cls", "vec", "first").mapInArrow(run, _FOUND), top)
    return materialize(_listed(best, classes, top).select("q", F.explode("list.row").alias("row")), "curve-truth")


def _search(classes: DataFrame, *, top: int, block: int, window: int, curves: int, recall: float, audit: int, width: str, figures: list | None) -> DataFrame:
    """(q, list) of each query class: its `top` nearest rows."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("cls"), "cls").select("vec").limit(FIT).collect()
    most = classes.agg(F.max("norm")).first()[0]
    model = (most, fit_curves(_lift(_matrix(pa.array([r["vec"] for r in sample], pa.binary()), width), most, False), curves))
    keys = classes.select("vec", "cls", "asked").mapInArrow(_keys(spark.sparkContext.broadcast(model), BITS, width), "curve int, key long, cls binary, query boolean")
    numbered = materialize(number_rows(materialize(keys, "curve-keys"), "curve", "key", "cls", "query", name="place"), "curve-places")
    entries = numbered.where("curve = 0").count()  # as many on every curve, which follow each other
    last = (entries - 1) // block
    placed = numbered.select("curve", F.expr(f"CAST((place % {entries}) div {block} AS INT)").alias("block"), "cls", "query")
    vectors = classes.select("cls", "vec", "first")
    blocks = materialize(placed.where("NOT query").join(vectors, "cls").select("curve", "block", "cls", "vec", "first"), "curve-blocks")
    queries = materialize(placed.where("query").join(vectors, "cls").select("curve", F.col("block").alias("home"), "cls", "vec"), "curve-queries")
    true = _truth(classes, audit, top, width)
    if true is None:
        return classes.limit(0).select(F.col("cls").alias("q"), F.lit(None).cast("array<struct<far:double,none:boolean,vec_id:bigint,row:bigint>>").alias("list"))
    total = true.count()
    best, done = None, -1
    while True:
        whole = window >= last
        # every block on one curve is every class, whatever the curve
        on = blocks.where("curve = 0") if whole else blocks
        asked = queries.where("curve = 0") if whole else queries
        if best is None:
            asked = asked.withColumn("least", F.lit(-math.inf))
        else:
            # what a query has already: nothing below the last of a full list can enter it
            full = best.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == top).select(F.col("q").alias("cls"), "least")
            asked = asked.join(full, "cls", "left").withColumn("least", F.coalesce("least", F.lit(-math.inf)))
        homes = asked.withColumn("block", F.explode(F.expr(f"sequence(greatest(home - {window}, 0), least(home + {window}, {last}))"))).where(F.abs(F.col("block") - F.col("home")) > done)
        homes = homes.withColumn("span", F.expr(f"home div {SPAN}"))
        least, greatest = F.col("span") * SPAN, F.col("span") * SPAN + SPAN - 1
        dealt = on.withColumn("span", F.explode(F.expr(f"sequence(greatest(block - {window}, 0) div {SPAN}, least(block + {window}, {last}) div {SPAN})")))
        dealt = dealt.where(F.greatest(F.abs(F.col("block") - least), F.abs(greatest - F.col("block"))) > done)
        cell = ["curve", "block", "span"]
        found = homes.select(*cell, "cls", "vec", "least").groupBy(*cell).cogroup(dealt.select(*cell, "cls", "vec", "first").groupBy(*cell)).applyInArrow(_cell(top, width), _FOUND)
        best = materialize(_merged(found if best is None else best.unionByName(found), top), "curve-best")
        lists = _listed(best, classes, top)
        if whole:
            share = 1.0
        else:
            near = lists.join(true.select("q").distinct(), "q", "left_semi").select("q", F.explode("list.row").alias("row"))
            share = near.join(true, ["q", "row"]).count() / total
        if figures is not None:
            figures.append({"window": window, "blocks": last + 1, "recall": share})
        if whole or share >= recall:
            return lists
        done, window = window, 2 * window


def nearest_neighbours(
    vectors: DataFrame, queries: F.Column, *, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, block: int = BLOCK, window: int = WINDOW,
    curves: int = CURVES, recall: float = RECALL, audit: int = AUDIT, figures: list | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest other rows of each row for which `queries` (a condition on vec_id) holds.

    `figures` gets a dict for every window searched: its size, the blocks of a curve, the audited recall.
    """
    width = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    plain = rows.mapInArrow(_plain(width), "vec_id long, vec binary, norm double").where("vec IS NOT NULL")
    cls = F.substring(F.unhex(F.sha2("vec", 256)), 1, 16)
    plain = materialize(plain.select("*", cls.alias("cls"), F.monotonically_increasing_id().alias("row"), F.coalesce(queries, F.lit(False)).alias("asked")), "curve-rows")
    # a class can show no more than `top` rows, and one more where a query leaves itself out
    few = Window.partitionBy("cls").orderBy(F.col("vec_id").isNull(), "vec_id", "row")
    members = plain.withColumn("place", F.row_number().over(few)).where(F.col("place") <= top + 1).groupBy("cls").agg(
        F.first("vec").alias("vec"), F.first("norm").alias("norm"), F.min(F.coalesce("vec_id", F.lit(NO_ID))).alias("first"),
        F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "row")).alias("members"))
    asked = plain.where("asked").select("cls").distinct().withColumn("asked", F.lit(True))
    classes = materialize(members.join(asked, "cls", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "curve-classes")
    out = None
    for (length,) in sorted(classes.select(F.octet_length("vec")).distinct().collect()):
        found = _search(classes.where(F.octet_length("vec") == length), top=top + 1, block=block, window=window, curves=curves, recall=recall, audit=audit, width=width, figures=figures)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asking = plain.where("asked").select(F.col("cls").alias("q"), F.col("vec_id").alias("query_id"), F.col("row").alias("own"))
    others = F.slice(F.filter("list", lambda x: x["row"] != F.col("own")), 1, top)
    placed = asking.join(out, "q").select("query_id", F.posexplode(others).alias("at", "item"))
    return placed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "item.vec_id", (-F.col("item.far")).alias("score"))


def digest(vectors: DataFrame) -> DataFrame:
    """The `TOP` nearest rows of each row whose id is divisible by `EVERY`: query_id, rank, vec_id, score."""
    return nearest_neighbours(vectors, F.col("vec_id") % EVERY == 0)


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS other, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.r <> c.r AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id, other) QUALIFY rank <= {TOP}
"""
