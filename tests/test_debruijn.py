import random

import pytest
from pyspark.sql import functions as F

from strandflow.functions import dna
from strandflow.operators import debruijn as G


def graph(spark, k, *texts):
    return G.build(spark.createDataFrame([(t,) for t in texts], "sequence string"), k)


def named(edges, k):
    return {(r[0], r[1]): r[2] for r in edges.select(dna.decode(F.col("src"), k - 1), dna.decode(F.col("dst"), k - 1), "cnt").collect()}


def test_edges_and_stats(spark):
    edges = graph(spark, 5, "ATCGATCGAT")
    assert named(edges, 5) == {("ATCG", "TCGA"): 2, ("TCGA", "CGAT"): 2, ("CGAT", "GATC"): 1, ("GATC", "ATCG"): 1}
    s = G.stats(edges, 5).first()
    assert (s["num_nodes"], s["num_edges"], s["total_kmer_count"], s["avg_kmer_depth"], s["max_node_degree"]) == (4, 4, 6, 1.5, 2)


def test_removal(spark):
    edges = graph(spark, 3, "ATCG")
    tc = spark.createDataFrame([("TC",)], "s string").select(dna.encode(F.col("s")).alias("id"))
    assert edges.count() == 2 and G.remove_nodes(edges, tc).count() == 0
    assert G.add_edges(edges, edges).agg(F.sum("cnt")).first()[0] == 4


def tips(spark, *texts):
    return {r[0] for r in G.tip_starts(graph(spark, 3, *texts)).select(dna.decode(F.col("id"), 2)).collect()}


def test_tip_starts(spark):
    assert "AA" not in tips(spark, "AAAAA")
    assert "AT" not in tips(spark, "AAAAA", "AAAT") and "TC" in tips(spark, "ATCG")


def test_tips_go_with_an_isolated_root(spark):
    edges, found = G.trim_tips(graph(spark, 3, *["AAAAATTTTG"] * 5, "AAAAACCCG"))
    assert set(named(edges, 3)) == {("AT", "TT"), ("TT", "TT"), ("TT", "TG")} and found.count() == 1


def test_bubbles(spark):
    edges = graph(spark, 3, "AAACTTT", "AAAGTTT")
    found = G.find_bubbles(edges).collect()
    assert len(found) == 1 and len(found[0]["paths"]) == 2 and list(found[0]["weights"]) == [3, 3]
    assert G.pop_bubbles(edges)[0].count() == 5
    edges = graph(spark, 3, "AAACCCAAA", "AAAGGGAAA")
    assert edges.count() == 11 and G.pop_bubbles(edges)[0].count() == 7
    assert G.find_bubbles(graph(spark, 5, "ATCGATCGATCGATCG")).count() == 0


def test_simplify_settles(spark):
    edges, done = G.simplify(graph(spark, 3, *["AAAAAAAAAAG"] * 5, "AAAAAAAAAATT"), G.Simplification(5, 2.0, 20))
    assert edges.count() == 0 and done["iterations"] >= 1


def test_trails_use_every_edge_once(spark):
    rng = random.Random(9)
    edges = graph(spark, 4, *["".join(rng.choice("ATCG") for _ in range(80)) for _ in range(3)]).cache()
    rows = G.trails(edges).orderBy("trail", "rank").collect()
    assert len(rows) == edges.count() == len({(r["src"], r["dst"]) for r in rows})
    for a, b in zip(rows, rows[1:]):
        if a["trail"] == b["trail"]:
            assert a["dst"] == b["src"] and b["rank"] == a["rank"] + 1
        else:
            assert b["rank"] == 0


def test_contigs_rebuild_a_genome(spark):
    rng = random.Random(42)
    genome = "".join(rng.choice("ATCG") for _ in range(500))
    reads = [genome[i : i + 50] for i in range(0, 451, 10)]
    found = G.contigs(graph(spark, 15, *reads), 15, 30).collect()
    assert [r["sequence"] for r in found] == [genome] and found[0]["name"] == "contig_0000" and not found[0]["is_circular"]
    ring = G.contigs(graph(spark, 5, "ATCGGATCG" + "A"), 5, 1).collect()
    assert sum(r["num_kmers"] for r in ring) == graph(spark, 5, "ATCGGATCGA").count()


def test_length_stats(spark):
    df = spark.createDataFrame([("A" * 1000,), ("T" * 500,), ("G" * 2000,)], "sequence string")
    r = G.length_stats(df).first()
    assert (r["num_contigs"], r["total_bases"], r["n50"], r["n90"], r["max_length"]) == (3, 3500, 2000, 500, 2000)
    assert r["gc_content"] == pytest.approx(2000 / 3500)
    assert set(G.length_stats(df.limit(0)).first()) == {0}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (7, 8, 1), (9, 9, 1)], "src long, dst long, cnt long")
    assert {r["id"]: r["component"] for r in G.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}


def test_low_coverage(spark):
    edges = graph(spark, 3, *["ATCGATCG"] * 5, "ATCGGG")
    assert G.low_coverage_edges(edges, 3).count() < edges.count()
    assert G.low_coverage_nodes(edges, 3.0).count() <= edges.count()


def test_registered_bubbles_reach_beyond_34_edges(spark, tmp_path):
    from strandflow import catalog

    rng = random.Random(3)
    one = [rng.choice("ATCG") for _ in range(120)]
    two = list(one)
    for i in (50, 60):
        two[i] = "A" if one[i] != "A" else "T"
    rows = [(i, "".join(t)) for i, t in enumerate([one] * 3 + [two] * 2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert [r["nodes"] for r in catalog.dbg_bubbles(spark, f"file://{tmp_path}").collect()] == [42]


def test_assemble_pops_bubbles(spark):
    rng = random.Random(3)
    one = "".join(rng.choice("ATCG") for _ in range(60))
    two = one[:30] + ("A" if one[30] != "A" else "T") + one[31:]
    reads = spark.createDataFrame([(one,)] * 3 + [(two,)] * 2, "sequence string")
    assert [r["sequence"] for r in G.assemble(reads, 11, 2, 20).collect()] == [one]


def test_walks_isolated_nodes_and_counts(spark):
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 6), (3, 4, 7), (3, 5, 1), (10, 11, 1), (11, 12, 2), (12, 10, 3), (20, 21, 1), (21, 22, 1), (22, 21, 1)], "src long, dst long, cnt long")
    starts = spark.createDataFrame([(1,), (10,), (20,), (4,)], "id long")
    got = {r["id"]: (r["path"], r["weights"]) for r in G.paths_forward(edges, starts, 5).collect()}
    assert got == {1: ([1, 2, 3], [5, 6]), 10: ([10, 11, 12, 10], [1, 2, 3]), 20: ([20, 21, 22, 21, 22, 21], [1] * 5), 4: ([4], [])}
    back = {r["id"]: (r["path"], r["weights"]) for r in G.paths_backward(edges, spark.createDataFrame([(4,), (10,)], "id long")).collect()}
    assert back == {4: ([1, 2, 3, 4], [7, 6, 5]), 10: ([10, 11, 12, 10], [3, 2, 1])}
    assert {r["id"] for r in G.tip_ends(edges, 2).collect()} == {2, 3}
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    assert sorted(map(tuple, G.edge_counts(edges, pairs).collect())) == [(1, 2, 5), (2, 1, 0)]
    known = G.add_nodes(G.drop_nodes(G.nodes(edges), starts.where("id = 1")), spark.createDataFrame([(99,)], "id long"))
    assert {r["id"] for r in known.collect()} == {2, 3, 4, 5, 10, 11, 12, 20, 21, 22, 99}
    assert {r["id"]: r["neighbors"] for r in G.neighbors(edges, "in").collect()}[21] == {20: 1, 22: 1}


def test_assembler_runs_from_reads_to_file(spark, tmp_path):
    rng = random.Random(42)
    genome = "".join(rng.choice("ATCG") for _ in range(300))
    snp = genome[:150] + ("A" if genome[150] != "A" else "C") + genome[151:]
    rows = [(i, genome[i : i + 50]) for i in range(0, 251, 5)] * 2 + [(1000 + i, snp[i : i + 50]) for i in range(110, 150, 5)]
    reads = spark.createDataFrame(rows, "read_id long, sequence string")
    made = G.Assembler(k=15, min_kmer_count=1, min_contig_length=30, bubble_max_length=20).assemble(reads, f"file://{tmp_path}/fa")
    assert made.removed["bubbles_removed"] >= 1 and made.before.first()["num_edges"] > made.after.first()["num_edges"]
    assert [r["sequence"] for r in made.contigs.collect()] == [genome]
    assert made.stats.first()["n50"] == 300 and spark.read.text(f"file://{tmp_path}/fa").where("value LIKE '>%'").count() == 1
    assert G.Assembler.default() == G.Assembler(31, 2, 200, 10, 2.0, 100, 5)


def test_tips_exchange_the_graph_once(spark):
    ends = spark.createDataFrame([(1, 2, 2), (2, 3, 2), (3, 4, 2), (9, 3, 2)], "src long, dst long, cnt long")
    spark.sparkContext.setJobGroup("tips", "")
    kept, tips = G.trim_tips(ends, G.Simplification(tip_max_length=10))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("tips"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.seed for r in tips.collect()) == [1, 9]
    assert jobs < 40, jobs


def test_starts_of_paths_are_made_once(spark):
    """Starts may cost a pass over all edges; and a round writes only the places it adds."""
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(40)], "src long, dst long, cnt long")
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    starts = spark.range(0, 40, 10, 1).mapInArrow(count, "id long")
    got = {r["id"]: r["path"] for r in G.paths_forward(edges, starts, 25).collect()}
    assert got == {i: list(range(i, min(i + 25, 40) + 1)) for i in (0, 10, 20, 30)}
    assert made.value == 4


def test_contigs_without_nodes_are_the_same_and_write_none(spark, monkeypatch):
    from strandflow.operators import debruijn
    from strandflow.plans import numbering

    rng, written = random.Random(8), []
    whole = numbering.materialize
    monkeypatch.setattr(numbering, "materialize", lambda df, name: written.append(df.columns) or whole(df, name))
    one = "".join(rng.choice("ATCG") for _ in range(120))
    reads = spark.createDataFrame([(i, one[a : a + 60]) for i, a in enumerate((0, 0, 30, 30, 60, 60))], "read_id long, sequence string")
    with_, without = debruijn.assemble(reads, 11, 2, 20), debruijn.assemble(reads, 11, 2, 20, path_nodes=False)
    assert with_.drop("path_nodes").collect() == without.collect() and without.count() > 0
    assert ["path_nodes" in c for c in written] == [True, False]
