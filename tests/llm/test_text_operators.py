"""Decontamination, repeats, Jaccard join, BPE, PII against brute force."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm import bpe, decontam, jaccard, pii, runindex
from strandflow.llm.queries import vocabulary

from .fixtures import corpus, prose


def docs(spark, rows):
    """With columns named like outputs, to see that they do no harm."""
    return spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, n_words string, score int")


# ---- decontamination ----

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_decontaminate(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = {}
    for d, t in rows:
        w, hit, ids = WORD.findall(lower(t)), set(), set()
        for g, owners in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    ids |= owners
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    rows = corpus(1, 20)
    items = [(i, prose(rng, n)) for i, n in enumerate([12, 25, 3, 1, 10])] + [(5, None), (6, "  "), (7, "…")]
    rows += [(900 + i, f"{prose(rng, 4)} ({items[i][1].upper()}) {prose(rng, 4)}") for i in range(3)] + [(910, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r[1:6]) for r in decontam.digest(docs(spark, rows), bench).collect()}
    assert got == brute_decontaminate(rows, items)
    small = decontam.decontaminate(docs(spark, rows), bench, max_nodes=200)  # several automata
    assert {r["doc_id"]: len(r["hit_words"]) for r in small.collect()} == {d: v[1] for d, v in got.items()}


def test_decontamination_offsets_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "red stone")], "item_id long, text string")
    row = decontam.decontaminate(docs(spark, [(1, "é RED—stone! red,  Stone")]), bench).first()
    assert row["hit_words"] == [2, 3] and [("é RED—stone! red,  Stone"[s["start"] : s["end"]]) for s in row["hit_spans"]] == ["red,  Stone"]
    assert decontam.digest(docs(spark, []), bench).count() == 0
    assert not decontam.digest(docs(spark, [(1, "red stone")]), bench.limit(0)).first()["contaminated"]


# ---- repeated substrings ----


def brute_repeats(rows):
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2, 2000])
def test_repeats_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(runindex, "BLOCK_BYTES", 20_000)  # many blocks
    monkeypatch.setattr(runindex, "HOT", hot)
    rows = corpus(5, 30) + [(400, "x" * 300), (401, "x" * 120), (402, "ab" * 60), (403, "y" * 49), (404, "y" * 49)]
    got = {r["doc_id"]: tuple(r[1:5]) for r in runindex.digest(docs(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_repeats_edge_cases(spark):
    assert runindex.digest(docs(spark, [])).count() == 0
    t = "q" * 30 + "w" * 40
    rows = runindex.digest(docs(spark, [(None, t), (3, t), (3, t), (5, t)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 0), (3, 0), (3, 0), (5, 70)]


def test_run_index_equals_brute_force():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"ab\x00z") for _ in range(rng.randint(1, 40))) for _ in range(6)]
    texts = [b"a" * 55, b"a" * 60 + b"b" * 10] + [b"".join(rng.choice(words) for _ in range(rng.randint(20, 60)))[: rng.randint(50, 300)].ljust(50, b"a") for _ in range(40)]
    ids = sorted(rng.randint(0, 30) for _ in texts)
    sizes = np.array([len(t) - 49 for t in texts])
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
    index = runindex.RunIndex(np.frombuffer(b"".join(texts), np.uint8), starts, sizes, np.array(ids))
    assert index.length.sum() == sizes.sum() + len(texts) > len(index.length)  # rows are compressed to runs
    least = {}
    for d, t in zip(ids, texts):
        for i in range(len(t) - 49):
            least[t[i : i + 50]] = min(d, least.get(t[i : i + 50], d))
    position, base = index.matches()
    assert index.doc_of(position).tolist() == [least[t[i : i + 50]] for t in texts for i in range(len(t) - 49)]
    whole = b"".join(texts)
    assert all(whole[p : p + 50] == t[i : i + 50] for p, (t, i) in zip(position, ((t, i) for t in texts for i in range(len(t) - 49))))
    # what the walk reads are the runs: without their bytes it goes nowhere
    index.to = np.zeros_like(index.to)
    assert index.matches()[0].tolist() != position.tolist()


# ---- Jaccard join ----


def brute_components(rows, k=3, least=90):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_jaccard_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows = corpus(7, 40)
    base = prose(rng, 80).split()
    for i in range(60):  # a large group at the threshold
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(["x", "y", "z"])
        rows.append((1000 + i, " ".join(w)))
    for i in range(40):  # chains of near copies, and a shared passage
        w = (rows[i % 20][1] or "").split() + ["and"] * (i // 20)
        rows.append((2000 + i, " ".join(w[: len(w) // 2] + base[:9] + w[len(w) // 2 :])))
    want, loose = brute_components(rows), brute_components(rows, 5, 80)
    components = lambda **more: {r["doc_id"]: tuple(r[1:3]) for r in jaccard.jaccard_components(docs(spark, rows), **more).collect()}
    assert components() == want
    assert components(shingle=5, threshold=(80, 100)) == loose
    monkeypatch.setattr(jaccard, "CELL_ROWS", 9)  # groups and clusters become grids of cells
    monkeypatch.setattr(jaccard, "SLICE_BYTES", 3000)
    assert components() == want
    assert components(shingle=5, threshold=(80, 100)) == loose


def test_jaccard_does_not_link_words_with_equal_polynomials(spark):
    word = "a"
    for _ in range(11):  # Thue-Morse word of 2048 letters and its complement
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.digest(docs(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}


def test_jaccard_edge_cases(spark):
    assert jaccard.digest(docs(spark, [])).count() == 0
    got = jaccard.digest(docs(spark, [(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "A B C"), (9, None), (8, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 1, 0), (2, 1, 2), (4, 1, 2), (4, 1, 2), (8, 0, 8), (9, 0, 9)]


def test_parity_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 2**63, 40, dtype=np.uint64), rng.integers(0, 2**63, 40, dtype=np.uint64)
        b[: rng.integers(0, 40)] = a[0]
        a, b = np.unique(a), np.unique(b)
        starts = np.array([0, len(a), len(a) + len(b)])
        sketches, base = jaccard.whole_sketches(np.concatenate([a, b]), starts, np.array([4, 2]))
        assert jaccard.hamming(sketches, base, np.array([0]), np.array([1]))[0] <= len(np.setxor1d(a, b))


# ---- BPE ----


def test_bpe_equals_the_tokenizers_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(2)
    texts = [t for _, t in corpus(3, 20)]
    texts += ["don't I'll 're 's ", "   x\n\n y \t", "<|endoftext|>a<|endoftext|><|endoftext|>b", "aaaaaaaaaaaaaaaaaaaaaaaa", "\x00\x1c\x85\xa0 ", "１２ ²³ ⅷ"]
    texts += ["".join(rng.choice("ab 'cd1\n.é漢😀̀<|>") for _ in range(200)) for _ in range(40)]
    library = tokenizers.Tokenizer.from_file(vocabulary())
    got = {r["doc_id"]: r for r in bpe.digest(docs(spark, list(enumerate(texts))), vocabulary()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest(docs(spark, []), vocabulary()).count() == 0
    apart = bpe.decode_documents(bpe.encode_documents(docs(spark, list(enumerate(texts))), vocabulary()), vocabulary())
    assert {r["doc_id"]: r["decoded"] for r in apart.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_bpe_backtracks():
    spec = {"model": {"vocab": {c: i for i, c in enumerate(bpe.byte_alphabet())}, "merges": []}}
    n = 256
    for a, b in (("a", "b"), ("c", "d"), ("ab", "cd"), ("b", "c"), ("bc", "d")):
        spec["model"]["vocab"][a + b] = n
        spec["model"]["merges"].append([a, b])
        n += 1
    import json

    e = bpe.BytePairEncoder(json.dumps(spec))
    assert e.encode_bytes(b"abcd") == [spec["model"]["vocab"]["abcd"]]
    assert e.encode_bytes(b"abc") == [spec["model"]["vocab"]["ab"], spec["model"]["vocab"]["c"]]


# ---- PII ----

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


PERSONAL = [
    "write to a.b+c@mail.example.com, or x@y", "a@b.c@d.e @f.g h@i.j..k", "1.2.3.4 300.1.1.1 1.2.3.4.5 0001.2.3.255 é 9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (743) 555-3824 or +49 30 1234567890123456 or +1-2", "+1 (5) 4111 1111 1111 1111",
]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(6)
    texts = PERSONAL + ["".join(rng.choice("a1.@+ -()9\n") for _ in range(300)) for _ in range(60)] + [None, ""]
    rows = {r["doc_id"]: r for r in pii.digest(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert rows[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert {s for s in joined.split(",") if s} <= {s for s in rows[i]["spans"].split(",") if s}


def test_field_spreads_labels_and_leaves_clean_texts(spark):
    texts = ["call +1 (743) 555-3824 now. Later: 1 743 555 3824 again.", "order 1 743 555 3824 of 17435553999", "the year 1984 and 20000101", "mail a@b.example.com; bad@"]
    found = pii.find_pii(docs(spark, list(enumerate(texts * 5))), pii.learn(docs(spark, list(enumerate(texts * 5))))).where("doc_id < 4").orderBy("doc_id").collect()
    cut = [[texts[r["doc_id"]][s["start"] : s["end"]] for s in r["pii_spans"]] for r in found]
    assert cut[0] == ["+1 (743) 555-3824", "1 743 555 3824"] and cut[1] == [] and cut[2] == [] and cut[3] == ["a@b.example.com"]
    out = pii.redact(docs(spark, [(0, texts[0]), (1, None)]), pii.learn(docs(spark, list(enumerate(texts))))).orderBy("doc_id").collect()
    assert out[0]["text"] == "call <PHONE> now. Later: <PHONE> again." and out[1]["text"] is None
    assert pii.digest(docs(spark, [])).count() == 0


def exact_posteriors(m, model):
    """Posteriors of all mentions by adding up every labelling of a small text."""
    unary, pairs = pii.potentials(m, model)
    n, k = unary.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        p = np.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(t[labels[i], labels[j]] for i, j, t in pairs))
        out[np.arange(n), labels] += p
    return out / out.sum(1, keepdims=True)


REPEATED = [
    "call +1 (743) 555-3824 now. Later: 1 743 555 3824 again.", "743 555 3824, 743 555 3824", "a@b.example.com and A@b.example.com or c@d",
    "ring +44 20 7946 0958, write to x@y.example.org, pay 4111 1111 1111 1111 from 10.20.30.40", "20 7946 0958 and then 1234567 and 7654321 and 442079460958",
    "no. 1234567890 +1234567890 1234567890 x@y z@w", "1234567890 " * 4,
]


def test_loopy_posteriors_against_exact_enumeration():
    rows = Counter(e for t in REPEATED for e in pii.examples(t))
    model = pii.fit(sorted((*e, float(n)) for e, n in rows.items()))
    assert np.allclose(model["skip"], model["skip"].T) and np.allclose(model["near"], model["near"].T)
    trees = 0
    for t in REPEATED:
        m = pii.Mentions(t, pii.base_spans(t))
        got, want = pii.infer(m, model), exact_posteriors(m, model)
        tree = len(m.skip) + len(m.near) < len(m.spans)
        trees += tree
        assert np.abs(got - want).max() < (1e-5 if tree else 0.1), t
        assert (got.argmax(1) == want.argmax(1)).all(), t
    assert trees >= 4


def test_the_fit_is_a_maximum_and_learns_what_the_sample_says():
    rows = [(*e, float(n)) for e, n in Counter(e for t in REPEATED * 3 for e in pii.examples(t)).items()]
    model = pii.fit(rows)

    def objective(model):
        total = 0.0
        for has, near, skip, label, n in rows:
            score = sum(model["unary"][x] for x in has) + np.array(near) @ model["near"] + np.array(skip) @ model["skip"]
            total += n * (score[label] - np.log(np.exp(score - score.max()).sum()) - score.max())
        far = sum((w**2).sum() for w in model["unary"].values()) + (model["near"] ** 2).sum() + ((model["skip"] - pii.AGREE * np.eye(5)) ** 2).sum()
        return total - pii.PRECISION * far / 2

    best, rng = objective(model), np.random.default_rng(0)
    for _ in range(50):
        bump = rng.normal(0, 0.02, (5, 5))
        other = {"unary": {x: w + rng.normal(0, 0.02, 5) for x, w in model["unary"].items()}, "near": model["near"] + bump + bump.T, "skip": model["skip"] + bump + bump.T}
        assert objective(other) < best + 1e-3
    # where equal numbers are seen with other labels, agreement weakens; unary weights take their share
    apart = pii.fit([(("number",), (0,) * 5, (0, 0, 0, 0, 1), 0, 500.0)])
    assert apart["skip"][4, 4] - apart["skip"][4, 0] < pii.AGREE / 2
    score = apart["unary"]["number"] + apart["skip"][4]
    assert score[0] > score[4]
    assert pii.fit([])["unary"] == {}


def test_pii_of_repeated_rows_and_clashing_columns(spark):
    text = "call +1 (743) 555-3824"
    rows = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, None), (2, None, "y")], "doc_id long, text string, pii_spans string")
    found = pii.find_pii(rows, pii.learn(rows)).collect()
    assert sorted((len(r["pii_spans"]), r["doc_id"] or 0) for r in found) == [(0, 2), (1, 0), (1, 1), (1, 1)]
    assert pii.redact(rows, pii.learn(rows)).where("text = 'call <PHONE>'").count() == 3


def test_long_texts_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1.2.3." * 50_000, "+1 " * 60_000, "@" * 100_000):
        pii.base_spans(t)


def test_mentions_of_long_texts_take_linear_time():
    """Runs of a megabyte without a blank, with marks of every kind, in texts that hold an `@`."""
    import time

    model = pii.fit([])
    for t in ("a" * 1_000_000 + " x@y", "漢" * 1_000_000 + "@", "@" * 1_000_000, "Zm9v+/" * 170_000 + " a@b.cd", "a@b.cd " * 3000 + "x" * 1_000_000, "a@b.cd," * 3000):
        began = time.time()
        base, spans = pii.find_spans(t, model)
        assert set(base) <= set(spans) and time.time() - began < 5
    text = "write to me@x.org or ME@X.ORG. (a@b) end@"
    m = pii.Mentions(text, pii.base_spans(text))
    assert [text[a:b] for a, b in m.spans] == ["me@x.org", "ME@X.ORG.", "(a@b)", "end@"] and m.label == [1, 1, -1, -1]


def test_one_item_repeated_many_times(spark):
    """Copies of an item, and many items of one text, are one key; ids of all of them are returned; null ids hit words only."""
    item = " ".join(f"w{i}" for i in range(30))
    rows = [("one", item)] * 100_000 + [(f"i{k:05d}", item) for k in range(3000)] + [(None, item), (None, "only words hit here"), ("short", "w3 w4"), ("none", None), ("blank", " . ")]
    bench = spark.createDataFrame(rows, "item_id string, text string")
    d = spark.createDataFrame([(1, f"x {item} y"), (2, "w3 w4 w5"), (3, "only words hit here"), (4, None)], "doc_id long, text string")
    for nodes in (decontam.MAX_NODES, 100):
        got = {r["doc_id"]: r for r in decontam.decontaminate(d, bench, max_nodes=nodes).collect()}
        assert got[1]["hit_items"] == sorted(["one", "short", *(f"i{k:05d}" for k in range(3000))]) and len(got[1]["hit_words"]) == 30
        assert got[2]["hit_items"] == ["short"] and got[2]["hit_words"] == [0, 1]
        assert got[3]["hit_items"] == [] and len(got[3]["hit_words"]) == 4 and got[4]["n_words"] == 0


def test_texts_are_filtered_before_they_are_exchanged(spark):
    rows = spark.range(4000).selectExpr("id * 7 AS node", "repeat('x', 50) AS text")
    ids = spark.range(300).selectExpr("id * 70 AS node")
    found = jaccard._among(rows, ids, "node")
    nodes = {r.node for r in found.collect()}
    assert {70 * i for i in range(300)} <= nodes and len(nodes) < 1200
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


def test_little_is_written_beside_the_texts(spark):
    """Keys of sets are exchanged once and not written; of rows that are not asked for, few pass the filter."""
    rng = np.random.default_rng(10)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(1500)]
    texts += [t + " one more" for t in texts[:50]]
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = {r["doc_id"]: r["component_id"] for r in jaccard.digest(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: i - 1500 if i >= 1500 else i for i in range(1550)}
    written = sum(os.path.getsize(os.path.join(at, f)) for step in set(os.listdir(folder)) - before for at, _, files in os.walk(os.path.join(folder, step)) for f in files)
    assert written < 0.3 * sum(map(len, texts))
    rows = spark.range(4000).selectExpr("id * 7 AS node")
    assert jaccard._among(rows, spark.range(300).selectExpr("id * 70 AS node"), "node").count() < 420
