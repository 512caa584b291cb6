"""Sharding by histogram sort: exact splitters from repeated counts, then one exchange.

Rows are ordered by (md5 of the text, doc_id), so equal texts are neighbours. A key
table (16-byte key and size of each row) is written once. Each round counts, in every
partition, bytes and rows between the probes and brings one line per interval to the
driver: its bytes, rows and extreme keys. Every splitter's interval is probed again
between its extremes until the splitter is off by no more than `tolerance` of a shard,
or exact. Then rows go to their ranges in one exchange, a partition each, and are numbered
there. A shard of more than `RANGE_BYTES` is several ranges, `MAX_RANGES` over all: beyond
4 TB ranges grow, not what the driver holds. The counts give every range the number of its
first row, so slots stay gapless in a shard. Shards are cut by row numbers: rows that agree
in text and doc_id, and so in size, may be cut anywhere between them.

Edge cases: null texts have 0 bytes and sort like empty ones; null ids sort like 0; a very long
text is one row of one range; all rows that agree in text and doc_id are numbered in one range;
an empty table gives no rows; a row's size is the UTF-8 length of its text plus `ROW_BYTES`.
Input columns pass through, but for columns named like an output.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.session import materialize

SHARDS = 40
ROW_BYTES = 16
RANGE_BYTES = 64 << 20
MAX_RANGES = 1 << 16
#: Probes in each open interval of a round, and in all of them together.
PROBES, MAX_PROBES = 32, 1 << 19


def _size(text_col: str) -> F.Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES


def _key(text_col: str, id_col: str) -> F.Column:
    """16 bytes: the first 8 of the text's md5, and doc_id with its sign bit turned (so bytes sort as numbers do)."""
    digest = F.unhex(F.substring(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), 1, 16))
    flipped = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.concat(digest, F.unhex(F.lpad(F.hex(flipped), 16, "0")))


def _histogram(keys: DataFrame, probes: list[bytes]) -> list[tuple]:
    """(interval, rows, bytes, least key, greatest key); interval i holds keys >= probes[i-1] and < probes[i]."""
    shared = keys.sparkSession.sparkContext.broadcast(probes)  # at most PROBES for each splitter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(shared.value, "S16")
        total: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.frombuffer(b"".join(batch.column(0).to_pylist()), "S16")
            size = batch.column(1).to_numpy()
            at = np.searchsorted(edges, key, side="right") if len(edges) else np.zeros(len(key), np.int64)
            order = np.lexsort((key, at))
            at, key, size = at[order], key[order], size[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            last = np.append(first[1:], len(at)) - 1
            for i, n, b, lo, hi in zip(at[first].tolist(), (last - first + 1).tolist(), np.add.reduceat(size, first).tolist(), key[first], key[last]):
                lo, hi = bytes(lo).ljust(16, b"\0"), bytes(hi).ljust(16, b"\0")
                t = total.setdefault(i, [0, 0, lo, hi])
                total[i] = [t[0] + n, t[1] + b, min(t[2], lo), max(t[3], hi)]
        rows = [(i, *t) for i, t in total.items()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["i", "n", "b", "lo", "hi"])

    parts = keys.mapInArrow(run, "i int, n long, b long, lo binary, hi binary")
    found = parts.groupBy("i").agg(F.sum("n"), F.sum("b"), F.min("lo"), F.max("hi")).collect()
    return sorted((r[0], r[1], r[2], bytes(r[3]), bytes(r[4])) for r in found)


def _between(lo: bytes, hi: bytes, n: int) -> list[bytes]:
    """Up to n keys spread over (lo, hi]; all of them split off the least key or more."""
    a, b = int.from_bytes(lo, "big"), int.from_bytes(hi, "big")
    return sorted({(a + 1 + (b - a - 1) * k // max(n - 1, 1)).to_bytes(16, "big") for k in range(n)}) if b > a else []


def splitters(keys: DataFrame, cuts: int, tolerance: float = 0.0) -> tuple[list[bytes], list[int], list[int]]:
    """For each of cuts - 1 cuts into near equal bytes: a key, the rows below it, and the number of the cut's first row.

    Part k starts with the first row whose preceding bytes reach k / cuts of all bytes, or with one within
    `tolerance` of a part's bytes of that point. It has the key, or is a later one of the rows that share it.
    """
    (_, rows, total, least, greatest), *_ = _histogram(keys, []) or [(0, 0, 0, b"", b"")]
    if not rows:
        return [], [], []
    # by the least key of each known interval: rows and bytes below it; extremes, rows and bytes in it
    below = {least: (0, 0)}
    spans = {least: (least, greatest, rows, total)}
    goal = [total * k / cuts for k in range(1, cuts)]
    while True:
        starts = sorted(below)
        base = [below[p][1] for p in starts]
        open_spans = set()
        for g in goal:
            at = max(bisect.bisect_left(base, g) - 1, 0)
            lo, hi, _, size = spans[starts[at]]
            near = min(abs(base[at] - g), abs(base[at] + size - g))
            if lo < hi and near > tolerance * total / cuts and base[at] + size > g:
                open_spans.add(starts[at])
        if not open_spans:
            break
        each = max(2, min(PROBES, MAX_PROBES // len(open_spans)))
        probes = sorted({q for p in open_spans for q in _between(*spans[p][:2], each)})
        low, high = min(spans[p][0] for p in open_spans), max(spans[p][1] for p in open_spans)
        edges = sorted({*open_spans, *probes, *(q for p, q in zip(starts, starts[1:]) if p in open_spans)})
        part = keys.where((F.col("key") >= F.lit(bytearray(low))) & (F.col("key") <= F.lit(bytearray(high))))
        found = {i: x for i, *x in _histogram(part, edges)}
        for p in open_spans:
            n, b = below[p]
            i = bisect.bisect_right(edges, p)
            end = spans[p][1]
            while i <= len(edges) and edges[i - 1] <= end:
                if i in found:
                    got = found[i]
                    below[got[2]] = (n, b)
                    spans[got[2]] = (got[2], got[3], got[0], got[1])
                    n, b = n + got[0], b + got[1]
                i += 1
            if p not in (x[2] for x in found.values()):
                below.pop(p), spans.pop(p)
    starts = sorted(below)
    base = [below[p][1] for p in starts]
    out, first, cut = [], [], []
    for g in goal:
        at = bisect.bisect_left(base, g)
        if tolerance:
            at = min((k for k in (at - 1, at) if 0 <= k < len(starts)), key=lambda k: abs(base[k] - g), default=at)
        inside = spans[starts[at - 1]] if at else None
        if not tolerance and inside and inside[0] == inside[1] and base[at - 1] + inside[3] > g:  # rows that share a key
            out.append(inside[0])
            first.append(below[inside[0]][0])
            cut.append(first[-1] + math.ceil((g - base[at - 1]) * inside[2] / inside[3]))
        else:
            out.append(starts[at] if at < len(starts) else b"\xff" * 16)
            first.append(below[starts[at]][0] if at < len(starts) else rows)
            cut.append(first[-1])
    return out, first, cut


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, *, text_col: str = "text", id_col: str = "doc_id", tolerance: float = 0.0) -> DataFrame:
    """Add size (long), shard (int) and slot (long, gapless from 0 in each shard); shards hold near equal bytes."""
    docs = docs.drop(*[c for c in ("size", "shard", "slot") if c not in (text_col, id_col)])
    keyed = docs.withColumn("_key", _key(text_col, id_col)).withColumn("size", _size(text_col))
    keys = materialize(keyed.select(F.col("_key").alias("key"), "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per = max(1, min(-(-total // (n_shards * RANGE_BYTES)), MAX_RANGES // n_shards))
    edges, first, cut = splitters(keys, n_shards * per, tolerance)
    firsts, cuts = np.array([0, *first], np.int64), np.array([0, *cut[per - 1 :: per]], np.int64)  # of ranges, of shards
    shared = docs.sparkSession.sparkContext.broadcast((np.array(edges, "S16"), firsts, cuts))
    added = [("_range", T.IntegerType()), ("_first", T.LongType()), ("_shard", T.IntegerType()), ("_cuts", T.ArrayType(T.LongType()))]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, firsts, cuts = shared.value
        ends = np.append(firsts[1:], np.iinfo(np.int64).max)
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column("_key").to_pylist()), "S16")
            at = np.searchsorted(edges, key, side="right") if len(edges) else np.zeros(len(key), np.int64)
            shard = np.searchsorted(cuts, firsts[at], side="right") - 1
            last = np.searchsorted(cuts, ends[at], side="left")  # shards that begin within the range
            inner = [cuts[a:b].tolist() for a, b in zip(shard + 1, last)] if (last > shard + 1).any() else [[]] * len(at)
            new = [pa.array(at.astype(np.int32)), pa.array(firsts[at]), pa.array(shard.astype(np.int32)), pa.array(inner, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(n for n, _ in added)])

    dealt = keyed.mapInArrow(ranges, T.StructType([*keyed.schema, *(T.StructField(*x) for x in added)]))
    dealt = dealt.repartitionById(len(edges) + 1, F.col("_range"))
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_range").orderBy("_key")) - 1
    begun = F.filter("_cuts", lambda c: c <= F.col("_row"))
    start = F.coalesce(F.array_max(begun), F.element_at(F.array(*(F.lit(int(c)) for c in cuts)), F.col("_shard") + 1))  # a number for each shard
    numbered = dealt.withColumn("_row", place)
    return (
        numbered.withColumn("shard", (F.col("_shard") + F.size(begun)).cast("int")).withColumn("slot", F.col("_row") - start)
        .drop("_key", "_row", *(n for n, _ in added)).select(*docs.columns, "size", "slot", "shard")
    )


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null)."""
    placed = shard_documents(docs.select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


ORACLE = """
WITH tab AS (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS v
             FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
k AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(strlen(text), 0) + 16 AS size, substr(md5(coalesce(text, '')), 1, 16) AS h FROM documents),
bytes AS (SELECT doc_id, size, h, list_transform(range(size - 16), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b
          FROM (SELECT doc_id, size, h, hex(encode(t)) AS x FROM k)),
c AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id) - size AS before, sum(size) OVER () AS total FROM bytes),
s AS (SELECT *, CAST(floor(before * 40 / total) AS INTEGER) AS shard FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size,
       xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, d: xor(v[(xor(c, d) % 256) + 1], c // 256))) AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s, tab
"""
