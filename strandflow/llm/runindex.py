"""Long repeated substrings across documents by run-compressed Burrows-Wheeler indexes.

A byte goes if it lies in a string of `LENGTH` bytes that also starts in a document with
a smaller doc_id. The method, in Spark stages:

1. Documents are packed into compressed blocks of a few MB, written once.
2. Anchors: every window of `LENGTH` bytes is assigned the least hash of its `SEED`-byte
   substrings, so equal windows have equal anchors wherever they stand. Each block sends
   every anchor once, with the number of its documents; anchors of two documents or more
   are shared, and only windows with a shared anchor can match.
3. Consecutive windows with the same shared anchor form a segment. A block sends each
   different segment once, with its least doc_id, to the bucket of its anchor, so all
   occurrences of a window meet in one bucket. Windows of a very frequent anchor (`HOT`
   documents or more) go one by one, by their own hash, so no bucket gathers a hot anchor.
4. A bucket builds a `RunIndex` of its different segments: a Burrows-Wheeler transform kept as
   runs, with the text position at the start of each run. Every segment streams through it from
   its end, a byte a step, by the last-to-first mapping of runs; each step gives the matching
   statistic of a window, cut at `LENGTH`, and by the samples of the context's runs the position
   of the match in the least doc_id. A match in a smaller doc_id than the window's is marked.
5. The marks go back to the blocks, which cut the documents.

Edge cases: null texts are empty; documents shorter than `LENGTH` stay whole; rows with
equal doc_id do not count as smaller for each other; rows with a null id stay whole and
never make others go; a text longer than a block is a block; kept bytes may split a code
point, so they are binary. Extra columns are ignored. Hashes (anchors, places of segments)
only choose what is compared; windows and segments are compared byte by byte.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.textpack import BYTE_VALUES, mix, prefix_sums, slices, span_hashes, text_bytes, window_hashes
from strandflow.session import materialize

LENGTH = 50
SEED = 24
BLOCK_BYTES = 2 << 20
#: Bytes of text that make up about one bucket of anchors, and one of segments.
ANCHOR_BUCKET_BYTES = 24 << 20
INDEX_BUCKET_BYTES = 4 << 20
#: Documents from which on an anchor's windows are dealt one by one.
HOT = 2000


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    for part in slices(batches, "text", BLOCK_BYTES):
        data, offsets = text_bytes(part.column("text"))
        ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([int.from_bytes(os.urandom(8), "little", signed=True)]), pa.array([ids.tobytes()]), pa.array([offsets.tobytes()]), pa.array([zstandard.compress(data.tobytes(), 6)])],
            names=["block", "ids", "offsets", "data"],
        )


_BLOCK = "block long, ids binary, offsets binary, data binary"


class _Block:
    """Windows of a packed block and their anchors."""

    def __init__(self, ids: bytes, offsets: bytes, data: bytes):
        import zstandard

        self.ids = np.frombuffer(ids, np.int64)
        self.offsets = np.frombuffer(offsets, np.int64)
        self.data = np.frombuffer(zstandard.decompress(data) if self.offsets[-1] else b"", np.uint8)
        n = len(self.data)
        self.starts = np.zeros(0, np.int64)
        if n < LENGTH:
            return
        self.sums = prefix_sums(self.data, BYTE_VALUES)
        least = window_hashes(self.sums, SEED)
        width, span = LENGTH - SEED + 1, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: -(width - span)], least[width - span :])
        sizes = np.diff(self.offsets)
        count = np.maximum(sizes - LENGTH + 1, 0)
        self.row = np.repeat(np.arange(len(sizes)), count)
        first = np.concatenate([[0], np.cumsum(count)])
        self.starts = self.offsets[:-1][self.row] + np.arange(first[-1]) - first[self.row]
        self.anchor = least[self.starts]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Different anchors and the number of their documents (255 at most is kept)."""
        if not len(self.starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        new = np.ones(len(self.anchor), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.row[1:] != self.row[:-1])
        a, r = self.anchor[new], self.ids[self.row[new]]
        order = np.lexsort((r, a))
        a, r = a[order], r[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
        return np.unique(a[new], return_counts=True)

    def segments(self, shared: np.ndarray, hot: np.ndarray, buckets: int):
        """Runs of windows with the same shared anchor.

        shared: sorted codes; hot: their flags. Returns for each run: first window, number of
        windows, number among the different runs; and for those, in order: one of
        their runs (of least doc_id), that doc_id, the segment bucket's hash.
        """
        none = np.zeros(0, np.int64)
        if not len(self.starts) or not len(shared):
            return none, none, none, none, none, np.zeros(0, np.uint64)
        cut = np.ones(len(self.anchor), bool)
        cut[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.row[1:] != self.row[:-1])
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, len(self.anchor)))
        code = codes(self.anchor[first], buckets)  # looked up once a run
        at = np.minimum(np.searchsorted(shared, code), len(shared) - 1)
        known = shared[at] == code
        first, size, code, single = first[known], size[known], code[known], hot[at[known]]
        if single.any():
            parts = np.where(single, size, 1)
            ends = np.cumsum(parts)
            first = np.repeat(first, parts) + np.where(np.repeat(single, parts), np.arange(ends[-1]) - np.repeat(ends - parts, parts), 0)
            size = np.where(np.repeat(single, parts), 1, np.repeat(size, parts))
            code, single = np.repeat(code, parts), np.repeat(single, parts)
        start = self.starts[first]
        place = mix(code)
        if single.any():
            place = np.where(single, span_hashes(self.sums, start, start + size + LENGTH - 1), place)
        ids = self.ids[self.row[first]]
        order = np.argsort(ids, kind="stable")
        found = _same_content(self.data, start[order], size[order] + LENGTH - 1)
        _, lead = np.unique(found, return_index=True)
        lead = order[lead]  # of least doc_id
        by_place = np.argsort(lead)  # numbers follow the text, which packs ids and numbers well
        rank = np.empty(len(lead), np.int64)
        rank[by_place] = np.arange(len(lead))
        number = np.empty(len(order), np.int64)
        number[order] = rank[found]
        lead = lead[by_place]
        return first, size, number, lead, ids[lead], place[lead]


def codes(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits of an anchor and its bucket in one number; rare collisions only add candidates."""
    return (anchor >> np.uint64(32)) * np.uint64(buckets) + anchor % np.uint64(buckets)


def _split(order_key: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(order_key, kind="stable")
    cut = np.searchsorted(order_key[order], np.arange(parts + 1))
    for i in range(parts):
        if cut[i] < cut[i + 1]:
            yield i, order[cut[i] : cut[i + 1]]


def _four(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def _from_four(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u4").astype(np.uint64)


def _pack_ints(x: np.ndarray) -> bytes:
    """Compressed differences of neighbours."""
    import zstandard

    return zstandard.compress(np.diff(x.astype(np.int64), prepend=0).tobytes(), 1)


def _unpack_ints(b: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.decompress(b), np.int64))


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                anchor, count = _Block(*packed).anchors()
                rows = [(i, block, _four(anchor[mine] >> np.uint64(32)), np.minimum(count[mine], 255).astype(np.uint8).tobytes())
                        for i, mine in _split((anchor % np.uint64(buckets)).astype(np.int64), buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "block", "anchors", "counts"])

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket: the shared anchors of each block, and which of them are hot."""
    blocks = table.column("block").to_pylist()
    parts = [_from_four(b) for b in table.column("anchors").to_pylist()]
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8)
    values, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(inverse, weights=counts)
    rows, at = [], 0
    for block, part in zip(blocks, parts):
        n = total[inverse[at : at + len(part)]]
        at += len(part)
        keep = n >= 2
        if keep.any():
            rows.append((block, _four(part[keep]), (n[keep] >= HOT).tobytes()))
    bucket = table.column("bucket")[0].as_py()
    cols = list(zip(*rows)) if rows else [[]] * 3
    return pa.table({"block": pa.array(cols[0], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "anchors": pa.array(cols[1], pa.binary()), "hot": pa.array(cols[2], pa.binary())})


def _shared_of(found: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    shared = np.concatenate([_from_four(f["anchors"]) * np.uint64(buckets) + np.uint64(f["bucket"]) for f in found])
    hot = np.concatenate([np.frombuffer(f["hot"], bool) for f in found])
    order = np.argsort(shared)
    return shared[order], hot[order]


def _bytes_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for a in range(0, len(start), 1 << 14):  # in steps, as places take eight times the bytes
        part = slice(a, a + (1 << 14))
        first, last = int(ends[a] - size[a]), int(ends[part][-1])
        out[first:last] = data[np.arange(first, last) + np.repeat(start[part] - (ends[part] - size[part]), size[part])]
    return out


def _send_segments(buckets: int, index_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for block, ids, offsets, data, found in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "offsets", "data", "found"))):
                b = _Block(ids, offsets, data)
                first, size, _, lead, doc, place = b.segments(*_shared_of(found, buckets), buckets)
                rows = []
                for i, mine in _split((place % np.uint64(index_buckets)).astype(np.int64), index_buckets):
                    n = size[lead[mine]]
                    blob = _bytes_of(b.data, b.starts[first[lead[mine]]], n + LENGTH - 1)
                    rows.append((i, block, _pack_ints(mine), _pack_ints(doc[mine]), _pack_ints(n), zstandard.compress(blob.tobytes(), 3)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=["bucket", "block", "numbers", "docs", "sizes", "blob"])

    return run


def _equal_groups(keys: list[np.ndarray]) -> np.ndarray:
    """Number of each row's group of equal keys: grouped by a hash, then compared key by key."""
    h = keys[0]
    for k in keys[1:]:
        h = mix(h) + k
    _, first, same = np.unique(mix(h), return_index=True, return_inverse=True)
    if any((k != k[first][same]).any() for k in keys):  # a collision of hashes
        _, same = np.unique(np.stack(keys, 1), axis=0, return_inverse=True)
    return same.reshape(-1)


class RunIndex:
    """Run-compressed Burrows-Wheeler transform, of order `LENGTH`, of segments sorted by doc_id.

    Rows are the windows of `LENGTH` bytes in sorted order, and for each segment the row of the
    `LENGTH` - 1 bytes that are left after its last window, from which a walk begins. Rows of one
    context (equal bytes) are ordered by the byte before them, then by doc_id. A run is a stretch of
    rows with the same context and the same byte before (none before a segment's first window). Of rows
    only runs are kept: context and byte + 1 (`key`), length, and the text position of its first row
    (`sample`), which has the least doc_id of the run.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray):
        """starts: where each segment begins in the text; sizes: its number of windows; docs: its doc_id, ascending."""
        self.text, self.starts, self.sizes, self.docs = text, starts, sizes, docs
        which = np.repeat(np.arange(len(starts)), sizes)
        base = np.concatenate([[0], np.cumsum(sizes)])
        n = int(base[-1])
        at = np.concatenate([starts[which] + np.arange(n) - base[which], starts + sizes])
        padded = np.concatenate([text, np.zeros(9, np.uint8)])
        eight = np.zeros(len(text) + 1, np.uint64)
        for i in range(8):
            eight = (eight << np.uint64(8)) | padded[i : i + len(eight)]
        keys = [eight[at + i] for i in range(0, LENGTH - 8, 8)]
        last = np.concatenate([eight[at[:n] + LENGTH - 8], eight[at[n:] + LENGTH - 9] << np.uint64(8)])
        keys.append(last)  # overlaps the one before; orders and separates the same
        same = _equal_groups(keys)
        lead = np.unique(same, return_index=True)[1]
        rank = np.empty(len(lead), np.int64)
        rank[np.lexsort([k[lead] for k in keys[::-1]])] = np.arange(len(lead))
        context = rank[same]
        del keys, eight, same
        before = text[np.maximum(at - 1, 0)].astype(np.int64) + 1
        before[:n][at[:n] == starts[which]] = 0
        key = context << 9 | before
        order = np.argsort(key, kind="stable")  # rows come by doc_id, and stay so in a run
        heads = np.flatnonzero(np.diff(key[order], prepend=-1))
        self.key = key[order[heads]]
        self.length = np.diff(np.append(heads, len(order)))
        first = order[heads]
        # of the rows that stand for windows, the first of each run; a run of walk rows alone has none
        window_rows = np.add.reduceat((order < n).astype(np.int64), heads) if len(heads) else heads
        self.sample = np.where(first < n, at[first], -1)
        self.contexts = len(lead)
        self.begin = context[n:]  # context of the row where each segment's walk begins
        # LF: the rows before which c stands are, in order, the windows that begin with c
        byte = self.key & 511
        step = np.argsort(byte, kind="stable")
        count = np.cumsum(self.length[step])
        target = np.empty(len(step), np.int64)
        target[step] = count - self.length[step] - int(self.length[byte == 0].sum())
        windows = np.bincount(self.key >> 9, weights=window_rows, minlength=self.contexts).astype(np.int64)
        first_window = np.cumsum(windows) - windows  # windows before each context
        filled = np.flatnonzero(windows)
        at_context = np.searchsorted(first_window[filled], target, side="right") - 1
        self.to = filled[np.maximum(at_context, 0)] if len(filled) else np.zeros(len(target), np.int64)

    def least(self) -> np.ndarray:
        """For each context the text position of an occurrence in the least doc_id, from the samples of its runs; -1 without any."""
        some = np.flatnonzero(self.sample >= 0)
        where = self.key[some] >> 9
        out = np.full(self.contexts, -1, np.int64)
        order = np.lexsort((self.sample[some], where))  # positions ascend with doc_id
        where, sample = where[order], self.sample[some][order]
        new = np.diff(where, prepend=-1) != 0
        out[where[new]] = sample[new]
        return out

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """Stream all segments, each from its end: (position, windows' offsets).

        A step goes from the context of a window, by the byte c before it, along LF of the run of c in
        that context to the context of the window before. The matching statistic of each window, cut at
        `LENGTH`, is its context's; position is that of its match in the least doc_id.
        """
        base = np.concatenate([[0], np.cumsum(self.sizes)])
        least, out = self.least(), np.empty(base[-1], np.int64)
        order = np.argsort(-self.sizes, kind="stable")
        at, left, place = self.starts[order] + self.sizes[order], self.sizes[order], base[1:][order]
        context = self.begin[order]
        for step in range(1, int(left[0]) + 1 if len(left) else 1):
            n = int(np.searchsorted(-left, -step, side="right"))  # segments that still have windows
            c = self.text[at[:n] - step].astype(np.int64) + 1
            context = self.to[np.searchsorted(self.key, context[:n] << 9 | c)]
            out[place[:n] - step] = least[context]
        return out, base

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return self.docs[np.searchsorted(self.starts, position, side="right") - 1]


def _same_content(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Number of each stretch's group of equal bytes."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    blob = _bytes_of(text, start, size)
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(blob.tobytes())])
    return every.dictionary_encode().indices.to_numpy().astype(np.int64)


def _match_bucket(table: pa.Table) -> pa.Table:
    import zstandard

    numbers, docs, sizes, blobs = [], [], [], []
    for a, d, s, b in zip(*(table.column(c).to_pylist() for c in ("numbers", "docs", "sizes", "blob"))):
        numbers.append(_unpack_ints(a))
        docs.append(_unpack_ints(d))
        sizes.append(_unpack_ints(s))
        blobs.append(np.frombuffer(zstandard.decompress(b), np.uint8))
    text, doc, size = np.concatenate(blobs), np.concatenate(docs), np.concatenate(sizes)
    start = np.concatenate([[0], np.cumsum(size + LENGTH - 1)[:-1]])
    # equal segments of different blocks are indexed once, with their least doc_id
    order = np.argsort(doc, kind="stable")
    found = _same_content(text, start[order], size[order] + LENGTH - 1)  # numbers in order of first, so least, doc_id
    _, lead = np.unique(found, return_index=True)
    lead, same = order[lead], np.empty(len(order), np.int64)
    same[order] = found
    length = size[lead]
    text = _bytes_of(text, start[lead], length + LENGTH - 1)
    index = RunIndex(text, np.concatenate([[0], np.cumsum(length + LENGTH - 1)[:-1]]), length, doc[lead])
    position, base = index.matches()
    matched = index.doc_of(position)
    rows, at = [], 0
    for block, a in zip(table.column("block").to_pylist(), numbers):
        mine = slice(at, at + len(a))
        at += len(a)
        n = length[same[mine]]
        ends = np.cumsum(n)
        hit = matched[np.arange(ends[-1]) + np.repeat(base[same[mine]] - (ends - n), n)] < np.repeat(doc[mine], n)
        rows.append((block, _pack_ints(a), _pack_ints(n), zstandard.compress(np.packbits(hit).tobytes(), 1)))
    return pa.table({c: pa.array(v, t) for c, v, t in zip(("block", "numbers", "sizes", "hits"), zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))})


def _cut(buckets: int):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for ids, offsets, data, found, marks in zip(*(batch.column(c).to_pylist() for c in ("ids", "offsets", "data", "found", "marks"))):
                b = _Block(ids, offsets, data)
                gone = np.zeros(len(b.data) + 1, np.int32)
                if found and marks:
                    first, size, number, lead, doc, _ = b.segments(*_shared_of(found, buckets), buckets)
                    base = np.concatenate([[0], np.cumsum(size[lead])])  # windows of the different segments
                    hit = np.zeros(base[-1], bool)
                    for m in marks:
                        a, n = _unpack_ints(m["numbers"]), _unpack_ints(m["sizes"])
                        bits = np.unpackbits(np.frombuffer(zstandard.decompress(m["hits"]), np.uint8), count=int(n.sum())).astype(bool)
                        ends = np.cumsum(n)
                        hit[np.arange(len(bits)) + np.repeat(base[a] - (ends - n), n)] = bits
                    ends = np.cumsum(size)
                    window = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
                    source = np.arange(ends[-1]) + np.repeat(base[number] - (ends - size), size)
                    later = np.repeat(b.ids[b.row[first]] > doc[number], size)  # copies inside the block
                    start = b.starts[window[hit[source] | later]]
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + LENGTH, -1)
                covered = np.cumsum(gone[:-1]) > 0
                edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                # a run that reaches over a border of documents is one in each
                inner = b.offsets[1:-1]
                inner = inner[(inner > 0) & (inner < len(covered))]
                touching = np.unique(inner[covered[inner - 1] & covered[inner]]) if len(inner) else inner
                begins = np.sort(np.concatenate([np.flatnonzero(edge == 1), touching]))
                finish = np.sort(np.concatenate([np.flatnonzero(edge == -1), touching]))
                owner = np.searchsorted(b.offsets, begins, side="right") - 1
                spans = [[] for _ in b.ids]
                for r, s, e in zip(owner.tolist(), (begins - b.offsets[owner]).tolist(), (finish - b.offsets[owner]).tolist()):
                    spans[r].append({"start": s, "end": e})
                kept_offsets = np.concatenate([[0], np.cumsum(~covered)])[b.offsets]
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b.ids), [None, pa.py_buffer(kept_offsets.astype(np.int64).tobytes()), pa.py_buffer(b.data[~covered].tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.ids), pa.array(np.diff(b.offsets)), pa.array(spans, spans_type), kept.cast(pa.binary())],
                    names=["doc_id", "n_bytes", "removed", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed: array of (start, end) bytes, kept: binary) of each document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialize(docs.where("doc_id IS NOT NULL").mapInArrow(_pack, _BLOCK), "repeat-blocks")
    ends = blocks.select(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets, index_buckets = max(8, -(-3 * ends // ANCHOR_BUCKET_BYTES)), max(8, -(-3 * ends // INDEX_BUCKET_BYTES))
    sent = blocks.mapInArrow(_send_anchors(buckets), "bucket int, block long, anchors binary, counts binary")
    found = sent.groupBy("bucket").applyInArrow(_shared_anchors, "block long, bucket int, anchors binary, hot binary")
    shared = materialize(found, "repeat-anchors").groupBy("block").agg(F.collect_list(F.struct("bucket", "anchors", "hot")).alias("found"))
    segments = blocks.join(shared, "block").mapInArrow(_send_segments(buckets, index_buckets), "bucket int, block long, numbers binary, docs binary, sizes binary, blob binary")
    marks = segments.groupBy("bucket").applyInArrow(_match_bucket, "block long, numbers binary, sizes binary, hits binary")
    marks = materialize(marks, "repeat-marks").groupBy("block").agg(F.collect_list(F.struct("numbers", "sizes", "hits")).alias("marks"))
    done = blocks.join(shared, "block", "left").join(marks, "block", "left").mapInArrow(
        _cut(buckets), "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"
    )
    whole = docs.where("doc_id IS NULL").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start: long, end: long>>").alias("removed"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"),
    )
    return done.unionByName(whole)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs).select(
        "doc_id", "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, hash(x[i + 1:i + 50]) AS h FROM (SELECT doc_id, x, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM p) WHERE first < doc_id),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
           SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
             SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit))
         GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM runs),
kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(CASE WHEN a > since THEN hex(x[since + 1:a]) ELSE '' END, '' ORDER BY a) AS head
         FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || CASE WHEN n > coalesce(last, 0) THEN hex(x[CAST(coalesce(last, 0) AS BIGINT) + 1:n]) ELSE '' END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
