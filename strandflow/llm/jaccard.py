"""Exact Jaccard self-join of shingle sets by parity sketches.

A set's shingles are dealt by hash to the blocks of its size band; a block is a parity
sketch of 2**64 bits, of which every shingle turns one over. It is kept as the number of
its shingles and the XOR of its bits' hashes. Two sets of a band whose Jaccard index
reaches the threshold differ in at most d shingles. The band has d + 1 + s blocks, so by
the pigeonhole principle at least s + 1 blocks are equal in both, and if every set sends
the d + 1 fullest of its blocks as join keys, the two still share a key (prefix filter;
nearly empty blocks, which unrelated sets share, are the ones left out). A set sends the
keys of its own band and, as the smaller side, of the next.

Sets that share a key are tested pair by pair: first the size bound, then the Hamming
distance of whole sketches, a lower bound of the symmetric difference. Only pairs that
pass are closed into candidate clusters, whose texts are then compared exactly.

Scale: identical sets are one class from the start, in each slice and again by a grouped
minimum over salted ids. Keys travel packed, one row for each slice and bucket, cut to 32
bits beside their bucket (keys that are taken as equal only add pairs to test), and are never
written but by this one exchange; groups of sets with the same holders are one group. A group or cluster beyond `CELL_ROWS` or
`CELL_BYTES` is dealt out twice: first everyone is compared with its least member, in many
cells; then only those it did not link are compared with everyone, in a grid of cells. A
hot group of copies of one text so costs one comparison a copy. Cells return a spanning
forest of the links they find. Nothing is capped or dropped.

Words: `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Set: distinct shingles of
`shingle` words (`SHINGLE` and `THRESHOLD` are those of op10); with fewer words, the whole
sequence as one. Edge cases: null, empty and wordless texts have an empty set and link with
nothing; repeated rows link with each other; rows of one id with different texts are one
document where links are followed; rows with a null id are left out of links and are their
own component; a very long text is one row of a cell; extra columns are ignored. Words and
shingles are compared by seeded 128-bit hashes: sets that hash alike are taken as equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.textpack import SPACE, combine, mix, row_starts, slices, word_lanes
from strandflow.plans.components import connected_components
from strandflow.session import materialize

SHINGLE = 3
#: Threshold as a fraction.
THRESHOLD = (90, 100)
#: Bytes of text whose keys make up about one bucket.
BUCKET_BYTES = 12 << 20
SLICE_BYTES = 3 << 20
CELL_ROWS = 1000
CELL_BYTES = 4 << 20
#: Salts by which the copies of a class are dealt out.
SALTS = 256
#: Bits for each id of the broadcast filter of rows, and most bits of all (16 MB in words).
ID_BITS = 64
MARK_BITS = 1 << 26


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the hashes of each row's distinct shingles, sorted in the row, and row starts."""
    one, two, rows = word_lanes(column, SPACE)
    starts = row_starts(rows, len(column))
    n = np.diff(starts)
    if not len(one):
        return one, two, np.zeros(len(column) + 1, np.int64)
    last = max(len(one) - k + 1, 0)
    at = np.flatnonzero(rows[:last] == rows[k - 1 :][:last])
    sh_rows = [rows[at]]
    lanes = [[combine(*(w[at + i] for i in range(k)))] for w in (one, two)]
    for size in range(1, k):
        few = np.flatnonzero(n == size)
        if len(few):
            first = starts[:-1][few]
            for w, lane in zip((one, two), lanes):
                lane.append(mix(combine(*(w[first + i] for i in range(size))) + np.uint64(size)))
            sh_rows.append(few)
    sh, sh2, sh_rows = (np.concatenate(x) for x in (*lanes, sh_rows))
    order = np.lexsort((sh, sh_rows))
    sh, sh2, sh_rows = sh[order], sh2[order], sh_rows[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sh2[1:] != sh2[:-1]) | (sh_rows[1:] != sh_rows[:-1])
    return sh[new], sh2[new], row_starts(sh_rows[new], len(column))


def band_edges(most: int, least: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """First sizes of bands; partners of a set are in its band, the one below or the one above."""
    num, den = least
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] * den // num + 1)
    edges.append(edges[-1] * den // num + 1)
    return np.array(edges, np.int64)


def most_apart(total: np.ndarray, least: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Largest symmetric difference of two sets of `total` elements together that reach the threshold."""
    num, den = least
    return total * (den - num) // (den + num)


def block_keys(sh: np.ndarray, starts: np.ndarray, band: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of each row, one row after the other: of `apart` + 1 and a quarter more blocks, the `apart` + 1 fullest."""
    sent = apart + 1
    blocks = sent + (sent + 3) // 4
    base = np.concatenate([[0], np.cumsum(blocks)])
    row = np.repeat(np.arange(len(blocks)), np.diff(starts))
    at = base[row] + (mix(sh) % blocks[row].astype(np.uint64)).astype(np.int64)
    parity = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(parity, at, mix(sh + np.uint64(3)))
    full = np.bincount(at, minlength=base[-1])
    owner = np.repeat(np.arange(len(blocks)), blocks)
    number = np.arange(base[-1]) - base[owner]
    keys = combine(parity, full.astype(np.uint64), number.astype(np.uint64), band[owner].astype(np.uint64))
    order = np.lexsort((keys, -full, owner))
    return keys[order[number < sent[owner]]], sent


def sketch_words(n: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """64-bit words of the whole sketches of sets of n elements: a power of two, with about 8 bits for each element apart."""
    words = np.maximum(most_apart(2 * n, least) / 8, 2)
    return np.minimum(1 << np.ceil(np.log2(words)).astype(np.int64), 1024)


def whole_sketches(sh: np.ndarray, starts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of `words` 64-bit words (powers of two) of each row, and where each begins.

    A sketch folds to one of half its size by XOR of its halves.
    """
    base = np.concatenate([[0], np.cumsum(words)])
    row = np.repeat(np.arange(len(words)), np.diff(starts))
    bit = (sh >> np.uint64(16)) & (words[row].astype(np.uint64) * np.uint64(64) - np.uint64(1))
    out = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(out, base[row] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out, base


def hamming(sketches: np.ndarray, base: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the sketches a and b (row numbers), the wider ones folded."""
    out = np.zeros(len(a), np.int64)
    words = np.diff(base)
    shapes = words[a] * 4096 + words[b]
    for shape in np.unique(shapes):
        all_of = np.flatnonzero(shapes == shape)
        step = max((1 << 20) // int(shape // 4096 + shape % 4096), 1)
        for at in range(0, len(all_of), step):
            some = all_of[at : at + step]
            x, y = (sketches[base[i][:, None] + np.arange(w)] for i, w in ((a[some], int(shape // 4096)), (b[some], int(shape % 4096))))
            x, y = (x, y) if x.shape[1] >= y.shape[1] else (y, x)
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            out[some] = np.bitwise_count(x ^ y).sum(1)
    return out


def _digests(sh: np.ndarray, sh2: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set, one of each half of the hashes."""
    n = np.diff(starts)
    a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        a[some] = np.add.reduceat(mix(sh), starts[:-1][some])
        b[some] = np.add.reduceat(mix(sh2), starts[:-1][some])
    return a, mix(b + n.astype(np.uint64))


_PACKED = "bucket int, ids binary, n binary, d1 binary, d2 binary, sketches binary, nodes binary, counts binary, keys binary"


def _node(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return (d1 ^ d2).view(np.int64)


def _sketch(buckets: int, id_col: str, text_col: str, shingle: int, least: tuple[int, int]):
    """Rows of negative buckets hold (id, set size, digests, sketch) of a slice; the others nodes and their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, SLICE_BYTES):
            sh, sh2, starts = shingle_sets(part.column(text_col), shingle)
            n = np.diff(starts)
            d1, d2 = _digests(sh, sh2, starts)
            ids = part.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)
            sketches, _ = whole_sketches(sh, starts, sketch_words(n, least))
            rows = [(-1 - int(mix(ids.view(np.uint64)).sum() % np.uint64(buckets)), ids.tobytes(), n.tobytes(), d1.tobytes(), d2.tobytes(), sketches.tobytes(), b"", b"", b"")]
            _, first = np.unique(np.stack([d1, d2], 1), axis=0, return_index=True)
            first = np.sort(first[n[first] > 0])
            if len(first):
                size = n[first]
                own_starts = np.concatenate([[0], np.cumsum(size)])
                own = sh[np.arange(own_starts[-1]) + np.repeat(starts[first] - own_starts[:-1], size)]
                edges = band_edges(int(size.max()), least)
                home = np.searchsorted(edges, size, side="right") - 1
                both = [block_keys(own, own_starts, band, most_apart(2 * (edges[band + 1] - 1), least)) for band in (home, home + 1)]
                keys, counts = (np.concatenate(x) for x in zip(*both))
                nodes = np.tile(_node(d1[first], d2[first]), 2)
                owner = np.repeat(np.arange(len(nodes)), counts)
                bucket = (keys % np.uint64(buckets)).astype(np.int64)
                keys = (keys // np.uint64(buckets)).astype(np.uint32)  # its lower bits
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    mine = order[cut[i] : cut[i + 1]]
                    who, times = np.unique(owner[mine], return_counts=True)  # owners stay in order
                    rows.append((i, b"", b"", b"", b"", b"", nodes[who].tobytes(), times.astype(np.int32).tobytes(), keys[mine].tobytes()))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                             names=["bucket", "ids", "n", "d1", "d2", "sketches", "nodes", "counts", "keys"])

    return run


_MET = "grp long, node long, doc_id long, n_shingles long, d1 long, d2 long, sketch binary"


def _meet(table: pa.Table, least: tuple[int, int]) -> pa.Table:
    """Of a bucket of keys, groups (grp, node); of any other, the sets of its slices, with a null grp."""
    if table.column("bucket")[0].as_py() >= 0:
        return _holders(table)
    *numbers, sketches = (table.column(c).to_pylist() for c in ("ids", "n", "d1", "d2", "sketches"))
    ids, n, d1, d2 = (np.frombuffer(b"".join(x), np.int64) for x in numbers)
    ends = np.concatenate([[0], np.cumsum(8 * sketch_words(n, least))]).astype(np.int64)
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(sketches))])
    node = _node(d1.view(np.uint64), d2.view(np.uint64))
    return pa.table([pa.nulls(len(n), pa.int64()), *map(pa.array, (node, ids, n, d1, d2)), made.cast(pa.binary())], names=["grp", "node", "doc_id", "n_shingles", "d1", "d2", "sketch"])


def _holders(table: pa.Table) -> pa.Table:
    """Groups (grp, node) of the nodes that share a key, of one bucket; keys with the same holders give one group."""
    nodes, keys = [], []
    for n, c, k in zip(*(table.column(x).to_pylist() for x in ("nodes", "counts", "keys"))):
        nodes.append(np.repeat(np.frombuffer(n, np.int64), np.frombuffer(c, np.int32)))
        keys.append(np.frombuffer(k, np.uint32))
    nodes, keys = np.concatenate(nodes), np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    alike = keys[order][1:] == keys[order][:-1]
    many = np.zeros(len(keys), bool)
    many[1:] |= alike
    many[:-1] |= alike
    order = order[many]  # most keys have one holder
    nodes, keys = nodes[order], keys[order]
    order = np.lexsort((nodes, keys))
    nodes, keys = nodes[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    nodes, keys = nodes[new], keys[new]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(keys)))
    group = mix(np.add.reduceat(mix(nodes.view(np.uint64)), first) + size.astype(np.uint64)) if len(keys) else np.zeros(0, np.uint64)
    _, one = np.unique(group, return_index=True)
    one = one[size[one] > 1]
    ends = np.cumsum(size[one])
    at = np.arange(ends[-1] if len(one) else 0) + np.repeat(first[one] - (ends - size[one]), size[one])
    grp = np.repeat(group[one], size[one]).view(np.int64)
    nothing = pa.nulls(len(grp), pa.int64())
    return pa.table([pa.array(grp), pa.array(nodes[at]), nothing, nothing, nothing, nothing, pa.nulls(len(grp), pa.binary())], names=["grp", "node", "doc_id", "n_shingles", "d1", "d2", "sketch"])


def _cells(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, np.ndarray], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Run `work` on whole cells (grp, i, j); rows come sorted by cell. `work` gets rows and the borders of cells, and gives pairs of row numbers."""

    def done(rows: pa.Table, keys: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        pairs = np.array(work(rows, cuts), np.int64).reshape(-1, 2)
        node = rows.column("node").to_numpy()
        return pa.RecordBatch.from_arrays([*map(pa.array, (keys[pairs[:, 0], 0], keys[pairs[:, 0], 2].astype(np.int32), node[pairs[:, 0]], node[pairs[:, 1]]))], names=["grp", "j", "src", "dst"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = np.stack([held.column(c).to_numpy() for c in ("grp", "i", "j")], 1)
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1])
        if len(cuts) > 1:
            yield done(held.slice(0, cuts[-1]), keys, cuts)
            held = held.slice(cuts[-1]).combine_chunks()
    if held is not None:
        keys = np.stack([held.column(c).to_numpy() for c in ("grp", "i", "j")], 1)
        yield done(held, keys, np.array([0, len(keys)]))


def _spanning(n: np.ndarray, node: np.ndarray, side: np.ndarray, least: tuple[int, int], near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning links among rows. side: 0 compares with 1, 2 with all; near(i, js): the js to link with i."""
    num, den = least
    order = np.argsort(n, kind="stable")
    root, sizes, out = np.arange(len(n)), n[order], []
    for at, i in enumerate(order.tolist()):
        js = order[at + 1 : int(np.searchsorted(sizes, n[i] * den // num, side="right"))]
        js = js[(root[js] != root[i]) & ((side[js] != side[i]) | (side[i] == 2)) & (node[js] != node[i])]
        if len(js):
            for j in near(i, js).tolist():
                if root[j] != root[i]:
                    out.append((i, j))
                    root[root == root[j]] = root[i]
    return out


def near_in_cells(rows: pa.Table, cuts: np.ndarray, least: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of rows that span what the Hamming distance of whole sketches leaves linked in each cell."""
    num, den = least
    n, node, side = (rows.column(c).to_numpy() for c in ("n", "node", "side"))
    base = np.concatenate([[0], np.cumsum(sketch_words(n, least))])
    sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64)
    size = np.diff(cuts)
    out = []
    for m in range(2, 17):  # small cells: all their pairs at once
        first = cuts[:-1][size == m]
        if len(first):
            i, j = np.triu_indices(m, 1)
            a, b = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            fit = (np.maximum(n[a], n[b]) * num <= np.minimum(n[a], n[b]) * den) & ((side[a] != side[b]) | (side[a] == 2)) & (node[a] != node[b])
            a, b = a[fit], b[fit]
            fit = hamming(sketches, base, a, b) <= most_apart(n[a] + n[b], least)
            out += zip(a[fit].tolist(), b[fit].tolist())
    for first, m in zip(cuts[:-1][size > 16].tolist(), size[size > 16].tolist()):
        part = slice(first, first + m)

        def near(i: int, js: np.ndarray) -> np.ndarray:
            return js[hamming(sketches, base, np.full(len(js), first + i), first + js) <= most_apart(n[first + i] + n[first + js], least)]

        out += [(first + i, first + j) for i, j in _spanning(n[part], node[part], side[part], least, near)]
    return out


def links_in_cells(rows: pa.Table, cuts: np.ndarray, shingle: int, least: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of rows that span the links of each cell, every link tested on the sets themselves."""
    num, den = least
    sh, sh2, starts = shingle_sets(rows.column("text"), shingle)
    n, node, side = np.diff(starts), rows.column("node").to_numpy(), rows.column("side").to_numpy()
    out = []
    for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        m = end - first
        if m < 2:
            continue
        words = np.full(m, sketch_words(n[first:end].max(), least))
        sketches, base = whole_sketches(sh[starts[first] : starts[end]], starts[first : end + 1] - starts[first], words) if m > 4 else (None, None)

        def linked(i: int, j: int) -> bool:
            a, b = (slice(starts[first + x], starts[first + x + 1]) for x in (i, j))
            hit = np.minimum(np.searchsorted(sh[a], sh[b]), a.stop - a.start - 1)
            both = int(((sh[a][hit] == sh[b]) & (sh2[a][hit] == sh2[b])).sum())
            return den * both >= num * (a.stop - a.start + b.stop - b.start - both)

        def near(i: int, js: np.ndarray) -> np.ndarray:
            if sketches is not None:
                js = js[hamming(sketches, base, np.full(len(js), i), js) <= most_apart(n[first + i] + n[first + js], least)]
            return np.array([j for j in js.tolist() if linked(i, j)], np.int64)

        if n[first:end].min() > 0:
            out += [(first + i, first + j) for i, j in _spanning(n[first:end], node[first:end], side[first:end], least, near)]
    return out


def _linked(members: DataFrame, attach: Callable[[DataFrame], DataFrame], work, name: str) -> DataFrame:
    """Links (src, dst) that span what `work` finds in each group. members: grp, node, n; attach adds what `work` reads.

    Groups within a cell are compared at once. In wider ones all are compared with the
    least node, then those that it did not link with all.
    """
    pack = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    spread = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    grid = F.greatest(F.ceil(F.col("m") / CELL_ROWS), F.ceil(F.col("weight") * 16 / CELL_BYTES)).cast("int")
    sizes = members.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), F.min("node").alias("center"))
    wide = materialize(sizes.select("grp", "center", grid.alias("grid")).where("grid > 1"), name + "-wide")

    def run(dealt: DataFrame, places) -> DataFrame:
        cells = attach(dealt.withColumn("c", F.explode(places)).select("grp", "node", "n", "c.*"))
        cells = cells.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
        return materialize(cells.mapInArrow(partial(_cells, work=work), "grp long, j int, src long, dst long"), name)

    star = F.when(F.col("node") == F.col("center"), spread(F.col("grid"), lambda k: pack(k, F.lit(-1), 0))).otherwise(F.array(pack(place(F.col("grid")), F.lit(-1), 1)))
    found = run(members.join(wide, "grp", "left"), F.when(F.col("grid").isNull(), F.array(pack(F.lit(0), F.lit(0), 2))).otherwise(star))
    if not wide.isEmpty():
        met = found.where("j = -1").select("grp", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("met", F.lit(True))
        inside = members.join(wide, "grp").join(met, ["grp", "node"], "left").withColumn("left", F.col("met").isNull() & (F.col("node") != F.col("center")))
        left = inside.where("left").groupBy("grp").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("rest"))
        right = spread(F.col("rest"), lambda i: pack(i, place(F.col("grid")), 1))
        both = F.concat(right, spread(F.col("grid"), lambda j: pack(place(F.col("rest")), j, 0)))
        found = found.unionByName(run(inside.join(left, "grp"), F.when(F.col("left"), both).otherwise(right)))
    return found.select("src", "dst")


def _among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` (a long) is in `ids`, and few others, without exchanging the rows: a bit for each hash, `ID_BITS` for
    each id up to `MARK_BITS`, is broadcast in words of 64. With more ids more rows pass, never fewer."""
    size = min(max(ID_BITS * ids.count(), 64), MARK_BITS)
    mark, word, bit = (f"pmod(xxhash64({column}), {size}L){x}" for x in ("", " div 64", " % 64"))
    marks = ids.select(F.expr(mark).alias("_mark")).groupBy(F.expr("_mark div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_mark % 64 as int)))").alias("_bits"))
    return rows.join(F.broadcast(marks), F.expr(word) == F.col("_word")).where(F.expr(f"getbit(_bits, cast({bit} as int)) = 1")).drop("_word", "_bits")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id): links of documents whose sets of `shingle` words reach the threshold (a fraction), followed through."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    packed = known.mapInArrow(_sketch(buckets, "doc_id", "text", shingle, threshold), _PACKED)
    met = materialize(packed.groupBy("bucket").applyInArrow(lambda table: _meet(table, threshold), _MET), "jaccard-met")
    stats = met.where("grp IS NULL").drop("grp").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    groups = materialize(met.where("grp IS NOT NULL").select("grp", "node").distinct(), "jaccard-groups")

    # a class is the documents of one set; its copies are dealt by salt, and named by their least doc_id
    exact = ["d1", "d2", "n_shingles"]
    salted = materialize(stats.where("n_shingles > 0").groupBy(*exact, "node", "salt").agg(F.min("doc_id").alias("doc_id")), "jaccard-salted")
    classes = materialize(salted.groupBy(*exact, "node").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    shared = groups.select("node").distinct()
    wanted = materialize(classes.join(shared, "node", "left_semi").select(F.col("rep").alias("doc_id"), *exact), "jaccard-wanted")
    sketched = _among(stats.select("doc_id", *exact, "node", "sketch"), wanted.select("doc_id"), "doc_id").join(wanted, ["doc_id", *exact])
    sketched = materialize(sketched.select("node", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["node", "n"]), "jaccard-sketches")
    members = groups.withColumn("n", F.lit(0).cast("long"))
    near = _linked(members, lambda cells: cells.drop("n").join(sketched, "node"), partial(near_in_cells, least=threshold), "jaccard-near")
    clusters = connected_components(near)

    members = clusters.join(classes, "node").select(F.col("component").alias("grp"), F.col("rep").alias("node"), F.col("n_shingles").alias("n"))
    members = materialize(members, "jaccard-members")
    texts = _among(known.select(F.col("doc_id").alias("node"), "text"), members.select("node"), "node")
    links = _linked(members, lambda cells: cells.join(texts, "node"), partial(links_in_cells, shingle=shingle, least=threshold), "jaccard-links")
    components = connected_components(links)

    named = classes.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(*exact, F.coalesce("component", "rep").alias("component_id"))
    spread = salted.join(named, exact).select(*exact, "salt", "component_id")
    out = stats.join(spread, [*exact, "salt"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = docs.where("doc_id IS NULL").mapInArrow(partial(_sizes, shingle=shingle), "doc_id long, n_shingles long, component_id long")
    return out.unionByName(nameless)


def _sizes(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.diff(shingle_sets(batch.column("text"), shingle)[2])
        nothing = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, pa.array(n.astype(np.int64)), nothing], names=["doc_id", "n_shingles", "component_id"])


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return jaccard_components(docs)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
      JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = w.doc_id
"""
