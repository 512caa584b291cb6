"""Toxicity from class-conditional Kneser-Ney models over words.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased, kept as 64-bit hashes.
For each class c the interpolated model (modified Kneser-Ney discounts D) is
  P_c(w | v) = (N_c(. v w) - D) / N_c(. v .) + rest_c(v) * Q_c(w | v)
  Q_c(w | v) = (N(. v w) - D) / N(. v .) + rest(v) * P_c(w)
  P_c(w)     = (N_c(. w) - D) / N_c(. .) + rest_c * P(w)
with N_c(. x) the number of distinct words before x (so copied passages weigh once), N that of
both classes together, the rests what the discounts free, and P(w) the backoff that all documents share.
A text's evidence is log P_1 - log P_0 normalised by length, of the whole text and of its
most toxic window of `SPAN` words, since a toxic phrase may stand in a long text; a
logistic curve, fitted on labelled rows kept out of the counts, turns the two into the score.

Class counts come from whole texts of a bounded sample of labelled rows (`FIT_DOCS`
documents of each class, chosen by a hash of their id). The shared backoff counts are
gathered from all documents of the corpus: how many distinct words precede each word. A
word that neither class knows has the same backoff in both, so only the sample's words
need it, which bounds the model that is broadcast.

Edge cases: null and wordless texts have evidence 0 and so the score of an average text;
very long texts are scanned whole, in one slice; repeated rows score alike; repeated labels of a
document count as 1 if one of them is; null labels are left out; with only one labelled class,
or none, every score is its smoothed share. Rows with a null id are not held out and have no label.
Input columns pass through, but for columns named like an output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.llm.textpack import NOT_WORD, combine, mix, row_starts, slices, word_hashes
from strandflow.session import materialize

#: Bounds of the training sample: documents of each class for the counts and for the curve.
FIT_DOCS = 2000
CURVE_DOCS = 2500
#: Words of the windows whose evidence is compared.
SPAN = 2
#: Standard errors of a count that its discount takes at least.
ERRORS = 2.0
#: Bytes of a predecessor's hash that are compared, and of text whose pairs make about one bucket.
PREFIX = 5
BUCKET_BYTES = 24 << 20
START = np.uint64(0x5BF03635A1D3C9E7)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, of (word before, word), and row starts."""
    w, rows = word_hashes(column, NOT_WORD)
    starts = row_starts(rows, len(column))
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[starts[:-1][starts[:-1] < len(w)]] = START
    return w, before, starts


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _look(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, -1 where it is missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _spread(keys: np.ndarray, values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Values of `keys` (part of the sorted `table`) laid out along the table, 0 elsewhere."""
    out = np.zeros(len(table))
    out[_look(table, keys)] = values
    return out


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discount of each count: the modified Kneser-Ney one from the counts of counts, or `ERRORS` standard errors if that is more.

    What a few occurrences in a sample say about a rare expression is so left to the shared backoff.
    """
    n = [max(int((counts == k).sum()), 1) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.02) for k in (1, 2, 3)]
    return np.minimum(np.maximum(np.array([0.0, *d])[np.minimum(counts, 3)], ERRORS * np.sqrt(counts)), counts)


class Model:
    """Log-ratio tables: of known pairs, of known words, and of words before an unknown one."""

    def __init__(self, classes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], words: np.ndarray, backoff: np.ndarray):
        """classes: different (word before, word) and their counts, of both classes; words: sorted; backoff: their shared probability."""
        self.words = words
        every_v, every_w = (np.concatenate([c[i] for c in classes]) for i in (0, 1))
        self.pairs, first = np.unique(combine(every_v, every_w), return_index=True)
        self.contexts = np.unique(every_v)
        cv, cw = _look(self.contexts, every_v[first]), _look(words, every_w[first])
        both = sum(_spread(combine(v, w), n, self.pairs) for v, w, n in classes).astype(np.int64)
        shared = context_parts(every_v[first], both, self.contexts)
        pair_log, word_log, context_log, told = [], [], [], shared["kept"] > 0
        for v, w, n in classes:
            own = class_words(w, words, backoff) | context_parts(v, n, self.contexts)
            told = told | (_spread(combine(v, w), own["kept"], self.pairs) > 0)
            below = shared["kept"] / shared["seen"][cv] + shared["rest"][cv] * own["word"][cw]
            pair_log.append(np.log(_spread(combine(v, w), own["kept"], self.pairs) / np.maximum(own["seen"][cv], 1) + own["rest"][cv] * below))
            word_log.append(np.log(np.append(own["word"], own["word_rest"])))  # the last: words that the models lack
            context_log.append(np.log(own["rest"]))
        self.pair_ratio, self.word_ratio, self.context_ratio = ((x[1] - x[0]).astype(np.float32) for x in (pair_log, word_log, context_log))
        # pairs of which nothing is left after the discounts have the ratio of unknown ones
        self.pairs, self.pair_ratio = self.pairs[told], self.pair_ratio[told]
        known = self.context_ratio != 0
        self.contexts, self.context_ratio = self.contexts[known], self.context_ratio[known]

    def ratios(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """log P_1(word | word before) - log P_0 of every word, and row starts."""
        w, v, starts = tokens(column)
        ratio = self.word_ratio[_look(self.words, w)].astype(np.float64)  # -1 picks the last word
        at = _look(self.contexts, v)
        ratio[at >= 0] += self.context_ratio[at[at >= 0]]
        at = _look(self.pairs, combine(v, w)) if len(w) else at
        ratio[at >= 0] = self.pair_ratio[at[at >= 0]]
        return ratio, starts

    def evidence(self, column: pa.Array) -> np.ndarray:
        """For each row the difference of the length-normalised log-likelihoods of the whole text, and of
        its most toxic window of `SPAN` words (of the whole text, if it is shorter)."""
        ratio, starts = self.ratios(column)
        out = np.zeros((len(column), 2))
        n = np.diff(starts)
        some = np.flatnonzero(n)
        if len(some):
            first, end = starts[:-1][some], starts[1:][some]
            out[some, 0] = np.add.reduceat(ratio, first) / n[some]
            sums = np.concatenate([[0], np.cumsum(ratio)])
            at, stop = np.arange(len(ratio)), np.repeat(end, n[some])
            begin = np.minimum(at, np.maximum(stop - SPAN, np.repeat(first, n[some])))  # the last windows are whole ones
            to = np.minimum(begin + SPAN, stop)
            out[some, 1] = np.maximum.reduceat((sums[to] - sums[begin]) / (to - begin), first)
        return out


def context_parts(v: np.ndarray, n: np.ndarray, contexts: np.ndarray) -> dict[str, np.ndarray]:
    """kept: discounted counts n of different pairs with the contexts v; seen, rest: for each context its count and what its discounts free."""
    kept = n - _discounts(n)
    at = _look(contexts, v)
    seen = np.bincount(at, weights=n, minlength=len(contexts))
    mass = np.bincount(at, weights=kept, minlength=len(contexts))
    return {"kept": kept, "seen": seen, "rest": np.where(seen > 0, 1 - mass / np.maximum(seen, 1), 1.0)}


def class_words(w: np.ndarray, words: np.ndarray, backoff: np.ndarray) -> dict[str, np.ndarray]:
    """Lower order of a class from its different pairs (., w): word, P_c(w); word_rest, the factor of the shared backoff in it."""
    word, before = _counts(w)
    total = max(before.sum(), 1)
    own = before - _discounts(before)
    rest = 1 - own.sum() / total
    return {"word": _spread(word, own, words) / total + rest * backoff, "word_rest": rest}


def features(evidence: np.ndarray) -> np.ndarray:
    """Inputs of the curve: both differences, and a constant."""
    return np.column_stack([evidence, np.ones(len(evidence))])


def fit_curve(x: np.ndarray, y: np.ndarray, share: float = 0.5, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; class 1 weighs `share` of all rows."""
    weight = np.where(y == 1, share / max((y == 1).sum(), 1), (1 - share) / max((y == 0).sum(), 1)) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _sample(docs: DataFrame, labels: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Different texts (label, part, text), part `fit` or `curve`, of documents chosen by a hash of their id.

    The choice is made on the labels alone; it holds about `FIT_DOCS` + `CURVE_DOCS` ids a
    class, which bounds what is broadcast to find their texts, so no other text is shuffled.
    """
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = []
    for c in (0, 1):
        n = max(counts.get(c, 0), 1)
        curve = min(0.25, CURVE_DOCS / n)
        fit = min(1.0, curve + FIT_DOCS / n)
        part = F.when(place < curve, "curve").otherwise("fit").alias("part")
        chosen.append(labels.where((F.col("label") == c) & (place < fit)).select("doc_id", "label", part))
    known = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").where("text IS NOT NULL")
    return materialize(known.select("label", "part", "text").distinct(), "toxicity-sample")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different (label, u, v, w) of each batch: a word and the two before it."""
    for batch in batches:
        label = batch.column("label").to_numpy()
        for c in np.unique(label):
            w, v, starts = tokens(batch.column("text").filter(pa.array(label == c)))
            u = np.empty_like(v)
            u[1:] = v[:-1]
            u[starts[:-1][starts[:-1] < len(w)]] = START
            _, first = np.unique(combine(u, v, w), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), c, np.int32)), *(pa.array(x[first].view(np.int64)) for x in (u, v, w))], names=["label", "u", "v", "w"])


def _squeeze(x: np.ndarray) -> bytes:
    """Compressed differences of ascending numbers, or of small ones."""
    import zstandard

    return zstandard.compress(np.diff(x.astype(np.int32), prepend=np.int32(0)).tobytes(), 1)


def _expand(b: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.decompress(b), np.int32))


def _send_pairs(table: np.ndarray, buckets: int, batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Different (word of the table, word before it) of each slice, dealt to buckets by the word before.

    A row: bucket, bytes of a word before (its number, if the table has it; else `PREFIX` bytes of hash), numbers of the words,
    how many words are before each, and these.
    """
    number = 3 if len(table) < 1 << 24 else 4
    for part in slices(batches, text_col, 12 << 20):
        w, v, _ = tokens(part.column(text_col))
        at = _look(table, w)
        v, at = v[at >= 0], at[at >= 0]
        named = _look(table, v)
        for width, some in ((number, named >= 0), (PREFIX, named < 0)):
            low = named[some].astype(np.uint64) if width == number else v[some] & np.uint64((1 << 8 * PREFIX) - 1)
            bucket = (mix(low) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((low, at[some], bucket))
            a, low, bucket = at[some][order], low[order], bucket[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (low[1:] != low[:-1]) | (bucket[1:] != bucket[:-1])
            a, low, bucket = a[new], low[new], bucket[new]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(cut)).tolist():
                mine = slice(cut[i], cut[i + 1])
                k, n = np.unique(a[mine], return_counts=True)
                packed = low[mine].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (i, width)), *(pa.array([x], pa.binary()) for x in (_squeeze(k), _squeeze(n), packed))], names=["bucket", "width", "k", "n", "v"])


def _merge_pairs(table: pa.Table) -> pa.Table:
    """(k, n): different words before each word, of those of one bucket."""
    found = []
    for width in set(table.column("width").to_pylist()):
        keys, before = [], []
        for k, n, v in zip(*(table.filter(pc.equal(table.column("width"), width)).column(c).to_pylist() for c in ("k", "n", "v"))):
            keys.append(np.repeat(_expand(k), _expand(n)).astype(np.int32))
            wide = np.zeros((len(v) // width, 8), np.uint8)
            wide[:, :width] = np.frombuffer(v, np.uint8).reshape(-1, width)
            before.append(wide.reshape(-1).view(np.uint64))
        keys, before = np.concatenate(keys), np.concatenate(before)
        order = np.lexsort((before, keys))
        keys, before = keys[order], before[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (before[1:] != before[:-1])
        found.append(keys[new])
    k, n = np.unique(np.concatenate(found), return_counts=True)
    return pa.table({"k": k, "n": n})


def shared_backoff(corpus: DataFrame, words: np.ndarray, *, text_col: str = "text") -> np.ndarray:
    """For each of the sorted word hashes: its distinct predecessors in all documents.

    Pairs of a word of the model and the word before it are made distinct in slices, then over the
    corpus in buckets of the words before, so a frequent word is no group of its own; the driver gets
    one number per word, and the sample bounds the words. Words before that the model lacks are told apart by `PREFIX` bytes of hash.
    """
    total = corpus.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    shared = corpus.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _send_pairs(shared.value, buckets, batches, text_col)

    sent = corpus.select(text_col).mapInArrow(run, "bucket int, width int, k binary, n binary, v binary")
    found = sent.groupBy("bucket").applyInArrow(_merge_pairs, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words), np.int64)
    out[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return out


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """Model and curve. docs: doc_id and text of all documents; labels: doc_id (once each), label (0/1)."""
    labels = labels.where("label IN (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sample = _sample(docs, labels, counts)
    have = {(r[0], r[1]): r[2] for r in sample.groupBy("label", "part").count().collect()}
    odds = (counts.get(1, 0) / max(counts.get(0, 0), 1)) ** 0.5  # halfway between equal and true odds
    share = odds / (1 + odds)
    found = sample.where("part = 'fit'").mapInArrow(_pairs, "label int, u long, v long, w long").groupBy("label", "v", "w").agg(F.count_distinct("u").alias("n")).toArrow()
    found = found.sort_by([("label", "ascending"), ("v", "ascending"), ("w", "ascending")])
    label, v, w, n = (found.column(i).to_numpy() for i in range(4))
    classes = [(v[label == c].view(np.uint64), w[label == c].view(np.uint64), n[label == c]) for c in (0, 1)]
    if not (len(classes[0][0]) and len(classes[1][0]) and have.get((0, "curve")) and have.get((1, "curve"))):
        ones = have.get((1, "fit"), 0) + have.get((1, "curve"), 0)
        return {"constant": (ones + 0.5) / (sum(have.values()) + 1.0)}
    del found, label, v, w, n
    words = np.unique(np.concatenate([c[1] for c in classes]))
    before = shared_backoff(docs, words)
    backoff = (before + 0.5) / (before.sum() + 0.5 * len(words) + 1)
    model = Model(classes, words, backoff)
    del classes, before, backoff
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("label"), *map(pa.array, shared.value.evidence(batch.column("text")).T)], names=["label", "whole", "window"])

    held = sample.where("part = 'curve'").mapInArrow(weigh, "label int, whole double, window double").toArrow()
    y, *x = (held.column(i).to_numpy() for i in range(3))
    order = np.lexsort((x[1], x[0], y))  # sums do not depend on the order of rows
    return {"model": model, "curve": fit_curve(features(np.column_stack(x)[order]), y[order], share)}


def score(docs: DataFrame, learned: dict, *, text_col: str = "text") -> DataFrame:
    """Add score (double), predicted (int) and evidence (double, mean log ratio of a word)."""
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.DoubleType())]
    docs = docs.drop(*[f.name for f in added if f.name != text_col])
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # the sample's bounds are its bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in slices(batches, text_col):
            if "constant" in learned:
                p, mean = np.full(batch.num_rows, learned["constant"]), np.zeros(batch.num_rows)
            else:
                found = learned["model"].evidence(batch.column(text_col))
                p = 1 / (1 + np.exp(-np.clip(features(found) @ learned["curve"], -30, 30)))
                mean = found[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(mean)],
                names=[*batch.schema.names, *(f.name for f in added)],
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema, *added]))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence."""
    known = labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out()).where("label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    learned = learn(docs.select("doc_id", "text"), known)
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), learned).drop("text")
