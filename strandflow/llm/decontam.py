"""Benchmark decontamination with Aho-Corasick automata over normalised benchmark windows.

A text is normalised to its words (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased), and
each word that the benchmark has is one symbol. Every run of `window` words of an item (an item
of fewer words, but not none, is one window) is a key of the automaton. Each text is scanned
once; hits come back as word numbers and, through the words' byte spans, as code-point offsets
of the original text.

Scale: documents are not shuffled. An automaton holds at most about `MAX_NODES` nodes; a larger
benchmark is cut into blocks of windows (long items in pieces), collected one at a time, and the
documents are scanned block after block, each pass written. A worker builds a block's automaton once.

Edge cases: null texts and texts without words have no words and no hits; null or
wordless items have no windows; the windows of items with a null id hit words, but no item;
copies of an item, and items of one text, are one key of the automaton (item ids form a set); rows with a null doc_id are
rows like others; very long texts are scanned whole; an empty benchmark hits nothing. Input columns
pass through, but for columns named like an output, which the output replaces.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.session import materialize

WINDOW = 10
#: Nodes of an automaton, about 100 bytes each: a word of an item makes up to `window` of them.
MAX_NODES = 1 << 20
#: Words of a piece of an item.
PIECE_WORDS = 2000

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ \t-\r]+")
_OTHER = "\x01"


def normalized_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def item_pieces(text: str | None, window: int) -> list[list[bytes]]:
    """Words of an item in pieces that overlap by window - 1, so that each of its windows is in one of them."""
    words = normalized_words(text)
    return [words[i : i + PIECE_WORDS + window - 1] for i in range(0, max(len(words) - window + 1, min(len(words), 1)), PIECE_WORDS)]


def _symbol(n: int) -> str:
    return chr(n + 2 if n + 2 < 0xD800 else n + 2 + 0x800)


class Automaton:
    """Aho-Corasick automaton over word symbols; the value of a key is the number of its window."""

    def __init__(self, pieces: list[tuple], window: int):
        """pieces: (ids of its items, words joined by blanks), a text once."""
        import ahocorasick

        self.symbols: dict[bytes, str] = {}
        numbers: dict[str, int] = {}
        self.size: list[int] = []
        self.items = [tuple(ids) for ids, _ in pieces]
        self.owners: list[list[int]] = []  # pieces of a window
        for piece, (_, text) in enumerate(pieces):
            line = "".join([self.symbols.setdefault(w, _symbol(len(self.symbols))) for w in text.split(b" ")]) if text else ""
            for i in range(max(1, len(line) - window + 1) if line else 0):
                key = line[i : i + window]
                n = numbers.setdefault(key, len(numbers))
                if n == len(self.size):
                    self.size.append(len(key))
                    self.owners.append([piece])
                elif self.owners[n][-1] != piece:  # a piece's windows come one after the other
                    self.owners[n].append(piece)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS) if numbers else None
        for key, n in numbers.items():
            self.found.add_word(key, n)
        if numbers:
            self.found.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(last word, window) of every occurrence."""
        get = self.symbols.get
        return list(self.found.iter("".join([get(w, _OTHER) for w in words]))) if words and self.found is not None else []


def scan(text: str | None, automaton: Automaton) -> tuple[int, np.ndarray, set, list[tuple[int, int]]]:
    """Number of words, sorted numbers of the words hit, items hit, original spans."""
    words = normalized_words(text)
    found = automaton.hits(words)
    if not found:
        return len(words), np.zeros(0, np.int64), set(), []
    hit, runs = np.zeros(len(words), bool), []
    for end, n in found:
        at = end - automaton.size[n] + 1
        hit[at : end + 1] = True
        runs.append((at, end + 1))
    pieces = {p for n in {n for _, n in found} for p in automaton.owners[n]}
    ids = {item for p in pieces for item in automaton.items[p]}
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    chars = np.cumsum([0, *((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # code points before each byte
    original = sorted({(int(chars[spans[a][0]]), int(chars[spans[b - 1][1]])) for a, b in runs})
    return len(words), np.flatnonzero(hit), ids, original


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_nodes: int) -> Iterator[list[tuple]]:
    """Different pieces with the ids of their items, in blocks; each block is collected alone.

    A piece has at most `PIECE_WORDS` + window words and is in one block however often it occurs; blocks are dealt by hash, so
    they are of `max_nodes` nodes on average and of little more at most.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, len(words), b" ".join(words)) for i, t in zip(*(c.to_pylist() for c in batch.columns)) for words in item_pieces(t, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.binary()))], names=["item", "n", "words"])

    source = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    pieces = source.mapInArrow(cut, "item string, n long, words binary")
    # the ids of copies are made different before they are gathered; a null id adds none
    pieces = pieces.select("item", "n", "words").distinct().groupBy("words").agg(F.first("n").alias("n"), F.collect_list("item").alias("items"))
    pieces = materialize(pieces, "benchmark-pieces")
    total = (pieces.agg(F.sum("n")).first()[0] or 0) * window
    n = max(1, -(-total // max_nodes))
    part = F.pmod(F.xxhash64("words"), F.lit(n))
    for i in range(n):
        block = pieces if n == 1 else pieces.where(part == i)
        yield [(r[0], bytes(r[1])) for r in block.select("items", "words").collect()]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_nodes: int = MAX_NODES,
) -> DataFrame:
    """Add n_words, hit_words (sorted word numbers), hit_items (sorted strings), hit_spans.

    hit_spans are (start, end) code points of each occurrence in the original text.
    Blocks of the benchmark are scanned one after the other; nothing is shuffled.
    """
    added = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("hit_words", T.ArrayType(T.LongType())),
            T.StructField("hit_items", T.ArrayType(T.StringType())),
            T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        ]
    )
    names = {f.name for f in added}
    docs = docs.drop(*[c for c in docs.columns if c in names and c != text_col])
    schema = T.StructType([*docs.schema, *added])
    empty = [F.lit(0).cast("long"), *(F.array().cast(f.dataType) for f in added[1:])]
    out = docs.select("*", *(e.alias(f.name) for e, f in zip(empty, added)))
    sc = docs.sparkSession.sparkContext
    scanned = None
    for pieces in _blocks(benchmark, item_col, item_text_col, window, max_nodes):
        if scanned is not None:
            out = materialize(scanned, "scanned")
        scanned = out.mapInArrow(_scanner(sc.broadcast(pieces), text_col, window), schema)
    return scanned


#: The automaton a worker built last, by the name of its block.
_built: dict[str, Automaton] = {}


def _automaton(name: str, pieces: list[tuple], window: int) -> Automaton:
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(pieces, window)
    return _built[name]


def _scanner(pieces, text_col: str, window: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, pieces.value, window)
        for batch in batches:
            n, hits, ids, spans = [], [], [], []
            old = [batch.column(c).to_pylist() for c in ("hit_words", "hit_items", "hit_spans")]
            for text, h0, i0, s0 in zip(batch.column(text_col), *old):
                count, hit, found, original = scan(text.as_py(), automaton)
                n.append(count)
                hits.append(sorted({*h0, *hit.tolist()}) if h0 else hit.tolist())
                ids.append(sorted({*i0, *found}))
                spans.append(sorted({*((s["start"], s["end"]) for s in s0), *original}))
            new = {"n_words": n, "hit_words": hits, "hit_items": ids, "hit_spans": [[{"start": a, "end": b} for a, b in s] for s in spans]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[f.name], f.type) if f.name in new else batch.column(i) for i, f in enumerate(batch.schema)],
                schema=batch.schema,
            )

    return run


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = decontaminate(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH pat AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p) AS w FROM documents, pat),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p) AS w FROM benchmark, pat),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT dg.doc_id, dg.i, dg.n, win.item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM occ GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
