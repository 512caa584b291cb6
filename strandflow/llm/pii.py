"""Personal data by fixed patterns plus a skip-chain conditional random field.

Base spans come from four patterns (e-mail, IP, card, phone), leftmost and
non-overlapping per kind. The field then labels *mentions*: runs of digits with
phone-like separators, and blank-free strings holding an `@`. Its potentials are
 * emissions of a mention's shape (digit count, separators, dots, plus, Luhn),
 * transitions between mentions that follow each other closely,
 * skip edges between mentions of a document with the same or a similar content
   (equal digits, one number's last nine digits in the other, equal addresses).
Mentions that hold a base span are clamped to its kind; loopy sum-product passes
spread their labels along the edges, so that "+1 (743) 555-3824" also marks a later
"743 555 3824". A mention whose posterior for a kind reaches `MIN_POSTERIOR` becomes
a further span.

The potentials are fitted by pseudo-likelihood to the base labels of a bounded sample of
documents (`SAMPLE_DOCS`), under Gaussian priors, of which only that of skip edges expects
something: equal labels. A mention with a base span is an example as it is; where a skip
edge ties it to another, it is one more with the marks hidden by which its pattern knows it
(plus, three dots, Luhn digits, a dotted domain), so that the field learns what such
neighbours say of mentions the patterns miss. A mention without a base span is `other`, unless a skip edge ties it to a base span: those are
unknown, neither examples nor neighbours.

Edge cases: null texts are empty; spans are code points, end exclusive; added spans
never overlap base spans; very long texts are scanned by patterns that take linear
time. Input columns pass through, but for columns named like an output.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.llm.textpack import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SAMPLE_DOCS = 2000
#: Message passing ends when no message moves by more than this, or after so many passes.
SETTLED, SWEEPS = 1e-6, 200
MIN_POSTERIOR = 0.9
#: Code points between mentions that count as neighbours in the chain.
NEAR = 40
#: Precision of the Gaussian priors of all weights, and the prior mean of a skip edge's weight for equal labels.
PRECISION, AGREE = 1.0, 6.0
#: Steps of the fit, whose objective is convex.
STEPS = 600

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++@?")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,3}[0-9])+")
_RUN = re.compile(r"\S++")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _LOCAL.finditer(text):  # whole runs, so that no run is scanned twice
        start, end = max(m.start(), at), m.end()
        if text[end - 1] == "@" and end - 1 > start and (domain := _DOMAIN.match(text, end)):
            at = domain.end()
            yield start, at


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of `KINDS`."""
    out = []
    if not text:
        return out
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p[-4:] if len(p.lstrip("0")) < 4 else "999") <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Mentions:
    """Mentions of a text with shapes, keys, edges and the labels of base spans."""

    def __init__(self, text: str, base: list[tuple[str, int, int]]):
        found = [m.span() for m in _NUMBER.finditer(text)] if _DIGIT.search(text) else []
        found = [(a, b) for a, b in found if len(_NOT_DIGIT.sub("", text[a:b])) >= 7]
        if "@" in text:
            found += [m.span() for m in _RUN.finditer(text) if "@" in m[0]]
        self.spans = sorted(found)
        self.label, self.shapes, keys = [], [], defaultdict(list)
        k, starts = 0, [s[1] for s in base]
        for i, (a, b) in enumerate(self.spans):
            while k < len(base) and base[k][2] <= a:
                k += 1
            j = k
            while j < len(base) and starts[j] < b and base[j][2] <= a:
                j += 1
            self.label.append(LABELS.index(base[j][0]) if j < len(base) and starts[j] < b else -1)
            body = text[a:b]
            digits = _NOT_DIGIT.sub("", body)
            if "@" in body:
                self.shapes.append(("at", body.count("@"), "." in body.split("@")[-1]))
                keys["@", body.strip(".,;:!?\"'()<>[]").lower()].append(i)
            else:
                self.shapes.append(("number", min(len(digits), 20), "+" in body, body.count(".") == 3, " " in body, 12 <= len(digits) <= 19 and luhn(digits)))
                keys["#", digits].append(i)
                if 9 <= len(digits) <= 15:
                    keys["tail", digits[-9:]].append(i)
        edges = set()
        for same in keys.values():  # a chain through equal keys, with every base-labelled one as a hub
            edges.update(zip(same, same[1:]))
            hub = next((i for i in same if self.label[i] > 0), None)
            if hub is not None:
                edges.update((min(i, hub), max(i, hub)) for i in same if i != hub)
        self.skip = sorted(edges)
        self.near = [(i, i + 1) for i in range(len(self.spans) - 1) if self.spans[i + 1][0] - self.spans[i][1] <= NEAR and (i, i + 1) not in edges]


def features(shape: tuple) -> tuple[str, ...]:
    """Names of the features that a mention's shape has."""
    if shape[0] == "at":
        return ("at", *(["one at"] if shape[1] == 1 else []), *(["dotted domain"] if shape[2] else []))
    _, digits, plus, dots, blank, valid = shape
    return ("number", f"{digits} digits", *(name for name, has in (("plus", plus), ("three dots", dots), ("blank", blank), ("luhn", valid)) if has))


def hidden(shape: tuple) -> tuple:
    """The shape without the marks by which a base pattern knows it."""
    return ("at", shape[1], False) if shape[0] == "at" else ("number", shape[1], False, False, shape[4], False)


def examples(text: str) -> Iterator[tuple[tuple, tuple, tuple, int]]:
    """(features, numbers of near neighbours by label, of skip neighbours, label) of a text's mentions of known label."""
    m = Mentions(text, base_spans(text))
    known = [max(x, 0) for x in m.label]
    for i, j in m.skip:
        for one, other in ((i, j), (j, i)):
            if m.label[one] < 0 and m.label[other] > 0:
                known[one] = -1
    around = np.zeros((2, len(known), len(LABELS)), np.int64)
    for table, edges in zip(around, (m.near, m.skip)):
        for i, j in edges:
            if known[j] >= 0:
                table[i, known[j]] += 1
            if known[i] >= 0:
                table[j, known[i]] += 1
    for i, (shape, label) in enumerate(zip(m.shapes, known)):
        if label >= 0:
            for s in (shape, hidden(shape)) if label > 0 and around[1, i].any() else (shape,):
                yield features(s), tuple(around[0, i].tolist()), tuple(around[1, i].tolist()), label


def fit(rows: list[tuple[tuple, tuple, tuple, int, float]]) -> dict:
    """Potentials of greatest penalised pseudo-likelihood for (features, near, skip, label, number of times)."""
    k = len(LABELS)
    names = sorted({name for r in rows for name in r[0]})
    at = {name: i for i, name in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 2 * k))
    for r, (has, near, skip, _, _) in enumerate(rows):
        x[r, [at[name] for name in has]] = 1
        x[r, len(names):] = near + skip
    label = np.array([r[3] for r in rows], np.int64)
    times = np.array([r[4] for r in rows], np.float64)
    near, skip = slice(len(names), len(names) + k), slice(len(names) + k, None)
    mean = np.zeros((x.shape[1], k))
    mean[skip] = AGREE * np.eye(k)
    w, step, square = mean.copy(), np.zeros_like(mean), np.zeros_like(mean)
    for t in range(1, STEPS + 1):
        score = x @ w
        p = np.exp(score - score.max(1, keepdims=True)) if len(rows) else score
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), label] -= 1
        slope = x.T @ (p * times[:, None]) + PRECISION * (w - mean)
        for edge in (near, skip):  # edges have no direction
            slope[edge] = (slope[edge] + slope[edge].T) / 2
        step = 0.9 * step + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        rate = 0.1 * (1 - t / (STEPS + 1))
        w -= rate * (step / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    return {"unary": {name: w[i] for name, i in at.items()}, "near": w[near], "skip": w[skip]}


def learn(docs: DataFrame, *, text_col: str = "text") -> dict:
    """Potentials from about `SAMPLE_DOCS` documents that hold a digit or an `@`, chosen by a hash of their text."""
    has = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9]{3}|@"))
    n = has.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = has.where(place < min(1.0, SAMPLE_DOCS / max(n, 1))).distinct()  # copies count once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(e for text in batch.column(0) for e in examples(text.as_py()))
            has, near, skip, label = ([e[c] for e in found] for c in range(4))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(has, pa.list_(pa.string())), pa.array(near, longs), pa.array(skip, longs), pa.array(label, pa.int64()), pa.array(list(found.values()), pa.int64())],
                names=["has", "near", "skip", "label", "times"])

    found = rows.mapInArrow(run, "has array<string>, near array<long>, skip array<long>, label long, times long").groupBy("has", "near", "skip", "label").agg(F.sum("times").alias("times"))
    return fit(sorted((tuple(r[0]), tuple(r[1]), tuple(r[2]), r[3], float(r[4])) for r in found.collect()))


def potentials(m: Mentions, model: dict) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Log potentials of a text's mentions and of its edges; mentions with a base span are clamped to its kind."""
    none = np.zeros(len(LABELS))
    unary = np.array([sum((model["unary"].get(name, none) for name in features(s)), none) for s in m.shapes]).reshape(-1, len(LABELS))
    for i, x in enumerate(m.label):
        if x > 0:
            unary[i] = -1e4
            unary[i, x] = 0.0
    return unary, [(i, j, model["skip"]) for i, j in m.skip] + [(i, j, model["near"]) for i, j in m.near]


def infer(m: Mentions, model: dict) -> np.ndarray:
    """Posterior of each mention's labels by loopy sum-product passes."""
    unary, pairs = potentials(m, model)
    belief = unary.copy()
    if pairs:
        src = np.array([i for i, _, _ in pairs] + [j for _, j, _ in pairs])
        dst = np.array([j for _, j, _ in pairs] + [i for i, _, _ in pairs])
        table = np.array([t for _, _, t in pairs] + [t.T for _, _, t in pairs])
        back = np.concatenate([np.arange(len(pairs), 2 * len(pairs)), np.arange(len(pairs))])
        messages = np.zeros((len(src), len(LABELS)))
        for _ in range(SWEEPS):
            out = (belief[src] - messages[back])[:, :, None] + table
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - messages).max()
            messages = 0.5 * messages + 0.5 * new
            belief = unary.copy()
            np.add.at(belief, dst, messages)
            if moved < SETTLED:
                break
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find_spans(text: str | None, model: dict) -> tuple[list, list]:
    """Base spans and all spans of a text."""
    base = base_spans(text)
    if not text or not (("@" in text) or _DIGIT.search(text)):
        return base, base
    m = Mentions(text, base)
    if all(x > 0 for x in m.label):
        return base, base
    p = infer(m, model)
    added = []
    for i, (a, b) in enumerate(m.spans):
        best = int(p[i].argmax())
        if m.label[i] < 0 and best > 0 and p[i, best] >= MIN_POSTERIOR:
            added.append((LABELS[best], a, b))
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_pii(docs: DataFrame, model: dict, *, text_col: str = "text") -> DataFrame:
    """Add base_spans and pii_spans, arrays of (kind, start, end)."""
    added = [T.StructField("base_spans", _SPAN), T.StructField("pii_spans", _SPAN)]
    docs = docs.drop(*[f.name for f in added])
    schema = T.StructType([*docs.schema, *added])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [find_spans(t.as_py(), shared.value) for t in batch.column(text_col)]
            cols = [pa.array([[{"kind": x, "start": a, "end": b} for x, a, b in spans[j]] for spans in both], kind) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "base_spans", "pii_spans"])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, model: dict, *, text_col: str = "text") -> DataFrame:
    """Replace every span by its kind in angle brackets; other columns and null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            out = []
            for text in batch.column(text_col):
                text = text.as_py()
                parts, last = [], 0
                for kind, start, end in find_spans(text, shared.value)[1]:
                    if start >= last:
                        parts += [text[last:start], f"<{kind.upper()}>"]
                    last = max(last, end)
                out.append("".join(parts) + text[last:] if parts else text)
            cols = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _equals(kind: str):
    return lambda k: k == F.lit(kind)


def _joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    found = find_pii(docs.select("doc_id", "text"), learn(docs))
    counts = [F.size(F.filter(F.col("base_spans.kind"), _equals(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("pii_spans").alias("spans"))
