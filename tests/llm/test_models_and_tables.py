"""Sharding, language ID, toxicity, chat formatting, embeddings and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.llm import anngraph, chatformat, langid, sharding, toxicity

from .fixtures import corpus, prose


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, slot int, score string")


# ---- sharding ----


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_hold_near_equal_bytes(spark, shards):
    rows = corpus(2, 50) + [(2000 + i, "hot") for i in range(60)]
    got = sharding.shard_documents(docs(spark, rows), shards).collect()
    order = sorted(rows, key=lambda r: (hashlib.md5((r[1] or "").encode()).hexdigest()[:16], r[0]))
    size = [len((t or "").encode()) + 16 for _, t in order]
    before = np.cumsum([0, *size[:-1]])
    want, slots = {}, {}
    for (i, _), b, s in zip(order, before, size):
        k = int(b * shards // sum(size))
        want[i] = (s, k, slots.get(k, 0))
        slots[k] = slots.get(k, 0) + 1
    assert {r["doc_id"]: (r["size"], r["shard"], r["slot"]) for r in got} == want


def test_sharding_in_ranges_and_edge_cases(spark, monkeypatch):
    rows = corpus(4, 40)
    whole = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(docs(spark, rows), 3).collect()}
    monkeypatch.setattr(sharding, "RANGE_BYTES", 2000)
    cut = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(docs(spark, rows), 3).collect()}
    assert {k: v[1] for k, v in cut.items() if v[0] == 0} == {k: v[1] for k, v in whole.items() if v[0] == 0}
    for s in range(3):
        assert sorted(v[1] for v in cut.values() if v[0] == s) == list(range(sum(v[0] == s for v in cut.values())))
    assert sharding.digest(docs(spark, [])).count() == 0
    one = sharding.digest(docs(spark, [(1, None), (1, None)])).collect()
    assert sorted((r["shard"], r["slot"]) for r in one) == [(0, 0), (20, 0)]  # 0 and 16 of 32 bytes come before them
    assert {r["size"] for r in one} == {16} and {r["text_crc32"] for r in one} == {0}


def test_equal_rows_are_cut_between_shards(spark):
    rows = [(7, "same text")] * 400 + [(None, "none")] * 100 + [(i, f"t{i}") for i in range(300)]
    got = sharding.shard_documents(docs(spark, rows), 40).groupBy("shard").agg(F.sum("size"), F.count("*"), F.min("slot"), F.max("slot")).collect()
    mean = sum(r[1] for r in got) / 40
    assert len(got) == 40 and max(abs(r[1] - mean) for r in got) < 26
    assert all(r[3] == 0 and r[4] == r[2] - 1 for r in got)


def test_tolerance_bounds_the_splitters(spark):
    rows = [(i, prose(random.Random(i), 30)) for i in range(400)]
    got = sharding.shard_documents(docs(spark, rows), 4, tolerance=0.05).groupBy("shard").agg(F.sum("size")).collect()
    mean = sum(r[1] for r in got) / 4
    assert len(got) == 4 and max(abs(r[1] - mean) for r in got) <= 0.11 * mean


# ---- language ID ----

TONGUES = {"aa": "tik tak tol wer nim zot pel", "bb": "shoo woo loo faa raa mee", "cc": "xrix kqul vrex zkal mnop"}


def tongue(rng, lang, n):
    parts = TONGUES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, tongue(rng, lang, rng.randint(8, 80)), lang) for i in range(300) for lang in [rng.choice(list(TONGUES))]]
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, " 12 ²!", "aa"), (902, tongue(rng, "bb", 3000), None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.digest(df).collect()}
    held = [(i, lang) for i, _, lang in rows if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.95
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0.0 and got[902]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.digest(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.digest(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_is_the_least_compressed_size(spark):
    zstandard = pytest.importorskip("zstandard")
    rng = random.Random(6)
    rows = [(i, tongue(rng, lang, rng.randint(1, 600)), lang) for i in range(120) for lang in [rng.choice(list(TONGUES))]]
    df = spark.createDataFrame([(i, t, lang, 0.5, True) for i, t, lang in rows] + [(None, rows[0][1], "aa", 0.5, True)] * 2, "doc_id long, text string, lang string, score double, rejected boolean")
    dictionaries = langid.learn(df.where("doc_id IS NOT NULL").where(~langid.held_out()))
    assert sorted(dictionaries) == sorted(TONGUES) and all(len(d) <= langid.DICT_BYTES for d in dictionaries.values())
    got = langid.digest(df).collect()
    assert all(r["held_out"] is False for r in got if r["doc_id"] is None) and len(got) == 122
    for r in got:
        text = next(t for i, t, _ in rows if i == (r["doc_id"] or 0))
        data, size = "".join(c if c.isalpha() else " " for c in text.lower()), {}
        for lang, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            pieces = [data.encode()[k : k + langid.PIECE] for k in range(0, len(data), langid.PIECE)]
            size[lang] = sum(len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(p)) for p in pieces)
        best = min(size.values())
        assert size[r["lang_pred"]] == best
        assert abs(r["score"] - 1 / sum(2.0 ** -(n - best) for n in size.values())) < 1e-9


# ---- toxicity ----


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        words = prose(rng, rng.randint(20, 150)).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilething", "nastyword", "awfulname"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), "extra"))
    df = docs(spark, rows + [(5000, None), (5001, ""), (5002, "...")])
    lab = spark.createDataFrame(labels + [(5001, None, "x")], "doc_id long, toxic int, text string")
    got = {r["doc_id"]: r for r in toxicity.digest(df, lab).collect()}
    held = [(got[i]["predicted"], y) for i, y, _ in labels if got[i]["held_out"]]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got.values()) and len(got) == 703
    assert {r["predicted"] for r in toxicity.digest(df, lab.limit(0)).collect()} <= {0, 1}
    assert toxicity.digest(df.limit(0), lab).count() == 0


def test_model_equals_kneser_ney_by_hand(spark):
    rng = random.Random(2)
    words = "ab cd ef gh ij kl mn".split()
    texts = [[" ".join(rng.choice(words[c : c + 6]) for _ in range(rng.randint(1, 90))) for _ in range(12)] for c in (0, 1)]
    corpus_texts = texts[0] + texts[1] + ["op ab zz cd", "zz ab"]
    found = [r for c in (0, 1) for b in toxicity._pairs([pa.RecordBatch.from_pydict({"label": [c] * 12, "text": texts[c]})]) for r in b.to_pylist()]
    counts = [Counter((r["v"], r["w"]) for r in found if r["label"] == c) for c in (0, 1)]
    classes = [(*(np.array([k[i] for k in n], np.int64).view(np.uint64) for i in (0, 1)), np.array(list(n.values()))) for n in counts]
    known = np.unique(np.concatenate([c[1] for c in classes]))
    name = {int(toxicity.tokens(pa.array([x]))[0][0]): x for x in words}
    before = toxicity.shared_backoff(spark.createDataFrame([(t,) for t in corpus_texts], "text string").repartition(5), known)
    pairs = {(v, w) for t in corpus_texts for v, w in zip(["<s>", *t.split()], t.split())}
    assert before.tolist() == [sum(w == name[int(k)] for _, w in pairs) for k in known]
    share = {name[int(k)]: (b + 0.5) / (before.sum() + 0.5 * len(known) + 1) for k, b in zip(known, before)}
    model = toxicity.Model(classes, known, np.array([share[name[int(k)]] for k in known]))

    def discount(counts):
        n = [max(sum(x == k for x in counts), 1) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.02) for k in (1, 2, 3)]

    def triples(c):
        return {(u, v, w) for t in texts[c] for u, v, w in zip(["<s>", "<s>", *t.split()], ["<s>", *t.split()], t.split())}

    seen = [Counter((v, w) for _, v, w in triples(c)) for c in (0, 1)]
    both = seen[0] + seen[1]
    d = [discount(list(n.values())) for n in (*seen, both)]
    taken = lambda n, d: min(max(d[min(n, 3)], toxicity.ERRORS * n**0.5), n)

    def step(n, d, v, w, below):
        total = sum(x for (a, _), x in n.items() if a == v)
        if not total:
            return below
        return (n[v, w] - taken(n[v, w], d)) / total + sum(taken(x, d) for (a, _), x in n.items() if a == v) / total * below

    def by_hand(c):
        lower = Counter(w for _, w in seen[c])
        dl, total = discount(list(lower.values())), sum(lower.values())
        free = sum(taken(x, dl) for x in lower.values()) / total
        first = lambda w: (lower[w] - taken(lower[w], dl)) / total + free * (share.get(w) or 1 / (before.sum() + 0.5 * len(known) + 1))
        return lambda w, v: step(seen[c], d[c], v, w, step(both, d[2], v, w, first(w)))

    p = [by_hand(0), by_hand(1)]
    for v in ["<s>", *words, "never"]:
        for c in (0, 1):
            assert abs(sum(p[c](w, v) for w in [*words, "unknown"]) - 1) < 1e-9
    text = "ab op never kl cd unknown ij gh gh"
    ratio, _ = model.ratios(pa.array([text]))
    want = [np.log(p[1](w, v) / p[0](w, v)) for v, w in zip(["<s>", *text.split()], text.split())]
    assert np.allclose(ratio, want, atol=1e-5)


def test_toxicity_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(3, 60)) + (" vile" if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(3, 0), (3, 1)], "doc_id long, toxic int")
    one, many = (sorted((r["doc_id"], r["score"]) for r in toxicity.digest(docs(spark, rows).repartition(n), labels).collect()) for n in (1, 16))
    assert one == many


# ---- chat ----


def test_chat_round_trip_is_exact():
    nasty = ["<|im_end|>", "<\\|im_start|>assistant", "<\\\\|x", "<|", "\n<|im_end|>\n", "", "|>\\", "plain ü 漢"]
    messages = [(r, t) for r in ("user", "assistant", "odd\nrole\\n", "<|im_start|>") for t in nasty]
    text, mask = chatformat.render(messages)
    assert chatformat.parse(text) == messages
    assert [chatformat.unescape(text[a:b]) for a, b in mask] == [t for r, t in messages if r == "assistant"]


def test_events_fold(spark):
    log = [
        (1, 1, "start", 0, "user", "hi"), (1, 2, "start", 1, "assistant", "wr"), (1, 3, "delta", 1, None, "ong"), (1, 5, "regenerate", 1, None, ""),
        (1, 6, "delta", 1, None, "right"), (1, 4, "start", 2, "user", "gone"), (1, 7, "edit", 0, None, "hello"), (2, 1, "delta", 0, None, None), (None, 1, "start", 0, "user", "n"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, event string, turn long, role string, text string")
    got = {r["conv_id"]: chatformat.parse(r["formatted"]) for r in chatformat.format_conversations(df).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "right")], 2: [("unknown", "")], None: [("user", "n")]}


def test_conversations_equal_sql(spark):
    rows = [(1, 0, "user", "a" * 200, "x"), (1, 1, "assistant", None, "x"), (2, 0, "assistant", "<|im_end|> é", "x"), (3, 5, "user", "b", "x"), (3, 2, "system", "c", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations AS SELECT * FROM (VALUES " + ",".join(f"({a},{b},'{c}',{'NULL' if d is None else repr(d)})" for a, b, c, d, _ in rows) + ") t(conv_id, turn, role, text)")
    rel = con.sql(chatformat.ORACLE)
    assert sorted(map(tuple, chatformat.digest(df).select(*rel.columns).collect())) == sorted(rel.fetchall())
    assert [r["conv_id"] for r in chatformat.digest(df.limit(0)).collect()] == [-1]


# ---- embeddings ----


def brute_links(rows):
    good = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    ids = sorted(i for i, _ in rows)
    links = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.9} if i in good else set() for i in ids}
    root = {i: i for i in ids}
    for i in ids:
        todo = [i]
        while todo:
            for j in links[todo.pop()]:
                if root[j] > root[i]:
                    root[j] = root[i]
                    todo.append(j)
    return {i: (len(links[i]), root[i], root[i] == i) for i in ids}


@pytest.mark.parametrize("per, cell", [(250, 3000), (20, 3000), (60, 30)])
def test_embedding_links(spark, per, cell, monkeypatch):
    monkeypatch.setattr(anngraph, "PER_CLUSTER", per)
    monkeypatch.setattr(anngraph, "CELL_ROWS", cell)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(220, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(300 + i, x[0].tolist()) for i in range(20)]  # copies
    rows += [(400 + i, (x[1] + 0.05 * rng.normal(size=16)).tolist()) for i in range(40)]  # a tight group
    rows += [(500 + i, (x[2] + 0.2 * rng.normal(size=16)).tolist()) for i in range(40)]  # a loose group
    rows += [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, []), (604, [1.0, None]), (605, [1.0, 2.0]), (606, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, "k") for i, v in rows], "vec_id long, embedding array<double>, kept string")
    linked = anngraph.digest(df)
    got, want = {r["vec_id"]: tuple(r[1:4]) for r in linked.collect()}, brute_links(rows)
    found, true = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.97 * true
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.98
    assert anngraph.audit_recall(df, linked) > 0.95
    assert anngraph.digest(df.limit(0)).count() == 0


def test_a_loose_group_over_many_shards_keeps_its_links(spark, monkeypatch):
    monkeypatch.setattr(anngraph, "PER_CLUSTER", 20)
    monkeypatch.setattr(anngraph, "GROUP_ROWS", 250)
    rng = np.random.default_rng(11)
    centre = rng.normal(size=64)
    x = rng.normal(size=(1200, 64))
    x[:600] = centre + 0.235 * rng.normal(size=(600, 64)) * np.linalg.norm(centre) / 8  # a third of all rows and more, cosine about 0.95
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[i].tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = {r["vec_id"]: tuple(r[1:4]) for r in anngraph.digest(df).collect()}, brute_links(rows)
    assert sum(v[0] for v in want.values()) > 300_000 and got == want


def test_low_recall_widens_the_search(spark, monkeypatch):
    monkeypatch.setattr(anngraph, "_shard_edges", lambda assigned, threshold: assigned.select(assigned.rep.alias("a"), assigned.rep.alias("b")).limit(0))
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(60, 16)), 10, 0) + 0.25 * rng.normal(size=(600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r["vec_id"]: tuple(r[1:4]) for r in anngraph.digest(df).collect()} == brute_links(rows)


@pytest.mark.parametrize("n", [500, 3000])
def test_rare_links_are_audited(spark, n):
    """A few pairs among vectors that link with nothing: the audit sees some of them, and tells where it saw none."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    planted = 40
    for i in range(planted):
        side = rng.normal(size=64)
        side -= side @ x[i] * x[i]
        x[n - 1 - i] = 0.93 * x[i] + np.sqrt(1 - 0.93**2) * side / np.linalg.norm(side)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    told = []
    out = anngraph.link_embeddings(df, figures=told)
    assert out.agg(F.sum("n_links")).first()[0] >= 0.9 * 2 * planted
    assert told[-1]["exhaustive"] or told[-1]["audited_links"] >= 5 and told[-1]["recall"] >= 0.9
    if n == 500:
        told = []
        assert anngraph.link_embeddings(df.where(f"vec_id < {n - planted}"), figures=told).agg(F.sum("n_links")).first()[0] == 0
        assert not told[-1]["exhaustive"] and told[-1]["recall"] is None and told[-1]["audited_links"] == 0


# ---- pipeline ----


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from strandflow.session import materialize

    rng = random.Random(5)
    lang = [(i, " ".join(rng.choice("haus baum wald ist der die das und nicht".split()) if i % 2 else rng.choice("house tree wood is the and not here".split()) for _ in range(60)), "de" if i % 2 else "en", "s", 1) for i in range(60)]
    item = " ".join(f"question{i}" for i in range(14))
    rows = lang + [(100, lang[0][1], "en", "s", 1), (101, lang[2][1] + " " + item, "en", "s", 1), (102, None, None, "s", 0), (103, "123", "en", "s", 3), (104, "a quite different text here: call +1 (743) 555-3824 the house and the tree is not here in this wood", "en", "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    now = d
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, f"file://{tmp_path}"))
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        assert name == "BPE" or now.columns == d.columns
    assert {102, 103}.isdisjoint(seen["language ID"]) and len(seen["language ID"]) >= 60
    assert 100 not in seen["n-gram Jaccard join"] and 0 in seen["n-gram Jaccard join"]
    assert 101 in seen["n-gram Jaccard join"] and 101 not in seen["benchmark decontamination"]
    assert "<PHONE>" in seen["PII"][104]["text"] and seen["PII"][104]["n_chars"] == len(seen["PII"][104]["text"])
    text = seen["PII"][104]["text"]
    assert seen["BPE"][104]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert sorted(corpus_pipeline.run(spark, f"file://{tmp_path}").select("doc_id").toPandas().doc_id) == sorted(seen["BPE"])


def test_near_duplicates_of_the_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(6)
    base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    near = list(base)
    for i in (30, 70, 110, 150):
        near[i] = "changed"  # 176 of 216 shingles of five words
    far = list(base)
    for i in (20, 50, 80, 110, 140, 170):
        far[i] = "other"  # 166 of 226
    lone = [f"x{rng.randrange(10**9)}" for _ in range(50)]
    rows = [(1, base, "s"), (2, near, "s"), (3, far, "s"), (4, lone, "s"), (4, lone, "s"), (4, lone, "t"), (0, base, "s"), (1, ["a", "text", "of", "its", "own", "id", "twice"], "s"), (None, near, "s"), (None, ["without", "id", "but", "alone", "here"], "s")]
    rows = [(i, " ".join(w), s) for i, w, s in rows] + [(7, None, "s"), (8, " ", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.deduplicate(spark, df, "").collect()), key=str)
    want = [(False, 0, " ".join(base)), (False, 3, " ".join(far)), (False, 4, " ".join(lone)), (False, 1, "a text of its own id twice"), (True, 0, "without id but alone here"), (False, 7, None), (False, 8, " ")]
    assert got == sorted(want, key=str)
