"""Exact byte-level BPE by backtracking over longest token matches, and table decoding.

Encoding a pre-token: an Aho-Corasick pass gives the longest token match from the left,
again and again. If all neighbours are compatible, these are the merges' result. If not,
the encoder goes from left to right once more: at each position it takes the longest
token that the pair-compatibility rule allows after the previous one (shorter ones come
from a table of token prefixes) and steps back where none fits. Two neighbouring tokens are compatible when no merge across their
border would ever have been applied; the answers are kept in a table. Each position
is given up at most once, so the work is linear in the text. Decoding gathers bytes
through an offset table.

Edge cases: null and empty texts give no tokens; the texts of special tokens inside a
document become their ids, as in the tokenizers library; any Unicode text is covered
since all 256 bytes are tokens. Rows are independent, so repeated rows just repeat.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.llm.textpack import slices

#: The public split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The same pattern for texts below U+0250, whose classes are short enough to spell out.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(f" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-ɏ]")
_CACHE = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """Tables of one byte-level BPE vocabulary (the JSON text of a tokenizers file)."""

    def __init__(self, source: str):
        import ahocorasick
        import regex

        spec = json.loads(source)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        tokens: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in self.special}
        n = max([*tokens, *self.special.values()]) + 1
        self.lengths = [len(tokens.get(i, b"")) for i in range(n)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank, self.parts, self.born = {}, {}, dict.fromkeys(tokens, -1)
        for r, (a, b) in enumerate(merges):
            pair = (vocab[a], vocab[b])
            self.rank[pair] = r
            self.parts[vocab[a + b]], self.born[vocab[a + b]] = pair, r
        self.automaton = ahocorasick.Automaton()
        for i, t in tokens.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.whole = {t: i for i, t in tokens.items()}  # the longest match of a token's bytes is the token
        self.most = max(map(len, tokens.values()), default=0)
        self.shorter = [-1] * n  # the longest token that a token starts with, itself left out
        for i, t in tokens.items():
            self.shorter[i] = next((self.whole[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.whole), -1)
        self.left, self.right = _Table(lambda t: self._spine(t, 0)), _Table(lambda t: self._spine(t, 1))
        self.compatible = _Table(self._compatible)
        self.pieces = _Table(self._encode_piece, _CACHE)
        self._split = regex.compile(PATTERN).findall
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens on one edge of a token's merge tree, with the rank at which each is merged away."""
        out, gone = [], float("inf")
        while True:
            out.append((token, gone))
            if token not in self.parts:
                return out
            gone = self.born[token]
            token = self.parts[token][side]

    def _compatible(self, pair: int) -> bool:
        """Whether merging the bytes of both tokens (left << 32 | right) leaves exactly these two.

        A merge of rank r joins edge tokens a|b if it comes before a is taken by its own
        tree, and no later than b is: of equal merges the leftmost is applied first.
        """
        right, rank = self.left[pair & 0xFFFFFFFF], self.rank
        for a, gone_a in self.right[pair >> 32]:
            for b, gone_b in right:
                if (a, b) in rank and (r := rank[a, b]) < gone_a and r <= gone_b:
                    return False
        return True

    def _encode_piece(self, piece: str) -> bytes:
        return struct.pack(f"<{len(ids := self.encode_bytes(piece.encode()))}I", *ids)

    def encode_bytes(self, data: bytes) -> list[int]:
        if data in self.whole:
            return [self.whole[data]]
        compatible = self.compatible
        longest = [token for _, token in self.automaton.iter_long(data.decode("latin-1"))]
        for a, b in zip(longest, longest[1:]):
            if not compatible[a << 32 | b]:
                return self._backtrack(data, longest)
        return longest

    def _longest(self, data: bytes, at: int) -> int:
        for end in range(min(len(data), at + self.most), at, -1):
            token = self.whole.get(data[at:end])
            if token is not None:
                return token
        raise ValueError("the vocabulary lacks a byte")

    def _backtrack(self, data: bytes, longest: list[int]) -> list[int]:
        n, compatible, lengths, shorter = len(data), self.compatible, self.lengths, self.shorter
        first, at = {}, 0
        for token in longest:
            first[at] = token
            at += lengths[token]
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            before = out[-1] << 32 if out else -1
            while token >= 0 and not (alive[at + lengths[token]] and (before < 0 or compatible[before | token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                if at < n:
                    token = first.get(at, -1)
                    if token < 0:
                        token = first[at] = self._longest(data, at)
            else:
                alive[at] = 0
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._specials and any(s in text for s in self.special):
            parts = self._specials.split(text)
            return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        split = self._split if _BEYOND.search(text) else _LATIN.findall
        return b"".join(map(self.pieces.__getitem__, split(text)))

    def forget(self) -> None:
        """Empty the memory of pre-tokens, which would else stay in a reused worker."""
        self.pieces.clear()
        self.pieces.older = {}


class Decoder:
    """Bytes of all tokens in one array with an offset table."""

    def __init__(self, source: str):
        spec, alphabet = json.loads(source), byte_alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        texts = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        texts |= {i: t.encode() for t, i in special.items()}
        ordered = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.offsets = np.cumsum([0, *map(len, ordered)]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(ordered), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids (unsigned 32-bit array)."""
        ids = ids.astype(np.int64)
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)].tobytes()


class _Table(dict):
    """Remembers answers in two generations, so its memory is bounded and frequent keys stay."""

    def __init__(self, compute, most: int = 500_000):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


_LOADED: dict[tuple, object] = {}


def load(kind: type, source: str):
    """Tables of a vocabulary, kept for the worker's next tasks."""
    key = (kind.__name__, hashlib.sha256(source.encode()).hexdigest())
    if key not in _LOADED:
        for other in [k for k in _LOADED if k[0] == kind.__name__]:
            del _LOADED[other]
        _LOADED[key] = kind(source)
    return _LOADED[key]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str, *, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """Add `ids_col` (binary, little-endian unsigned 32-bit ids). `vocabulary`: path of a tokenizers JSON file on the driver.

    With `decoded_col` the ids are decoded in the same task and the text is added too. The vocabulary (a file
    of fixed size, a few MB) is broadcast; columns named like the outputs are replaced.
    """
    source = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))
    added = [T.StructField(ids_col, T.BinaryType())] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else [])
    docs = docs.drop(*(f.name for f in added))
    schema = T.StructType([*docs.schema, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(BytePairEncoder, source.value)
        back = load(Decoder, source.value) if decoded_col else None
        for batch in slices(batches, text_col):
            ids = [table.encode(t.as_py()) for t in batch.column(text_col)]
            new = [pa.array(ids, pa.binary())]
            if back:
                new.append(pa.array([_text(back, i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in added)])
        table.forget()

    return docs.mapInArrow(run, schema)


def _text(table: Decoder, ids: bytes | None) -> str:
    return table.decode(np.frombuffer(ids or b"", "<u4")).decode("utf-8", "replace")


def decode_documents(docs: DataFrame, vocabulary: str, *, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Add `text_col`, the text of `ids_col`; invalid UTF-8 becomes U+FFFD, null ids an empty text."""
    source = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))
    docs = docs.drop(text_col)
    schema = T.StructType([*docs.schema, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(Decoder, source.value)
        for batch in batches:
            texts = [_text(table, b.as_py()) for b in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return docs.mapInArrow(run, schema)


def digest_columns() -> list:
    return [
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    ]


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = encode_documents(docs.select("doc_id", "text"), vocabulary, decoded_col="decoded")
    return both.select("doc_id", *digest_columns())
