"""Registered queries of the library proper and their DuckDB SQL.

Reads are the letters A, T, C, G of `documents`; short signals are `embeddings`; long
signals are the values of `events` by user; log-probabilities are the 64 values of an
embedding and a 0 as 13 steps of 5 classes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow import sql
from strandflow.functions import ctc, dna, records
from strandflow.functions import signal as S
from strandflow.operators import basecall, debruijn, network, segments, signals
from strandflow.operators.edgetable import EdgeTable
from strandflow.operators.kmers import count_kmers, kmer_arrays
from strandflow.operators.pieces import Pieces
from strandflow.plans.numbering import number_within
from strandflow.session import materialize, shared_dir, table
from strandflow.sources import fasta, records_sink
from strandflow.streaming.signals import basecall_available, run_available

QUERIES: dict = {}
ORACLES: dict = {}


def _register(oracle: str | None = None):
    def add(f):
        name = f.__name__.lstrip("_")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return f

    return add


# ---- inputs ----


def reads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"), dna.bases(F.coalesce("text", F.lit(""))).alias("sequence"))


def short_signals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("read_id"), F.col("embedding").cast("array<double>").alias("signal"))


def long_points(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("read_id"), (F.row_number().over(order) - 1).alias("pos"), "value")


def log_probs(spark: SparkSession, sf: str) -> DataFrame:
    whole = short_signals(spark, sf).select("read_id", F.concat("signal", F.array(F.lit(0.0))).alias("signal"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda t: ctc.log_softmax(F.transform(F.slice("signal", t * 5 + 1, F.lit(5)), lambda x: x * 10)))
    return whole.select("read_id", rows.alias("lp"))


READS = "reads AS (SELECT doc_id AS read_id, upper(regexp_replace(coalesce(text, ''), '[^ATCGatcg]', '', 'g')) AS sequence FROM documents)"
SIGNALS = "signals AS (SELECT vec_id AS read_id, CAST(embedding AS DOUBLE[]) AS signal FROM embeddings)"
SHORT = SIGNALS + ", points AS (SELECT read_id, i - 1 AS pos, signal[i] AS value FROM (SELECT read_id, signal, unnest(generate_series(1, len(signal))) AS i FROM signals))"
POINTS = "points AS (SELECT user_id AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value FROM events)"


def code_sql(text: str) -> str:
    """A string of A, T, C, G as the number whose base-4 digits they are."""
    return f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({text}, ''), lambda c: CAST(strpos('ATCG', c) - 1 AS BIGINT))), lambda a, d: a * 4 + d)"


def kmers_sql(k: int, least: int = 1) -> str:
    return (
        f"{READS}, words AS (SELECT substr(sequence, i, {k}) AS w FROM (SELECT sequence, unnest(generate_series(1, length(sequence) - {k - 1})) AS i FROM reads WHERE length(sequence) >= {k})), "
        f"counted AS (SELECT w, count(*) AS cnt FROM words GROUP BY w HAVING count(*) >= {least}), kmers AS (SELECT {code_sql('w')} AS kmer, w, cnt FROM counted)"
    )


def edges_sql(k: int, least: int) -> str:
    return kmers_sql(k, least) + f", edges AS (SELECT kmer // 4 AS src, kmer % {4 ** (k - 1)} AS dst, cnt FROM kmers), ends AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"


K, LEAST = 15, 2


def graph(spark: SparkSession, sf: str, k: int = K, least: int = LEAST) -> DataFrame:
    return debruijn.build(reads(spark, sf), k, least)


# ---- k-mers ----


@_register(f"WITH {kmers_sql(5)} SELECT kmer, cnt FROM kmers")
def kmer_count(spark, sf):
    return count_kmers(reads(spark, sf), 5)


@_register(f"WITH {kmers_sql(9, 3)} SELECT kmer, cnt FROM kmers")
def kmer_count_min(spark, sf):
    return count_kmers(reads(spark, sf), 9, 3)


@_register(f"WITH {kmers_sql(7)}, both_ways AS (SELECT least(kmer, {code_sql('translate(reverse(w), $$ATCG$$, $$TAGC$$)')}) AS kmer, cnt FROM kmers) SELECT kmer, CAST(sum(cnt) AS BIGINT) AS cnt FROM both_ways GROUP BY kmer")
def kmer_canonical(spark, sf):
    return count_kmers(reads(spark, sf), 7, canonical=True)


@_register(f"WITH {kmers_sql(11, 2)} SELECT kmer, w AS bases, translate(reverse(w), 'ATCG', 'TAGC') AS reverse_bases, {code_sql('translate(reverse(w), $$ATCG$$, $$TAGC$$)')} AS reverse_code, kmer <= {code_sql('translate(reverse(w), $$ATCG$$, $$TAGC$$)')} AS is_canonical FROM kmers")
def kmer_codec(spark, sf):
    found = count_kmers(reads(spark, sf), 11, 2)
    bases = dna.decode(F.col("kmer"), 11)
    back = dna.reverse_complement_code(F.col("kmer"), 11)
    return found.select(dna.encode(bases).alias("kmer"), bases.alias("bases"), dna.reverse_complement(bases).alias("reverse_bases"), back.alias("reverse_code"), (F.col("kmer") <= back).alias("is_canonical"))


@_register(f"WITH {kmers_sql(6)} SELECT kmer, kmer // 4 AS prefix, kmer % 1024 AS suffix, (kmer // 4) * 4 + kmer % 4 AS edge, (kmer % 1024) * 4 % 1024 + 2 AS extended FROM kmers")
def kmer_nodes(spark, sf):
    code = F.col("kmer")
    src, dst = dna.prefix(code), dna.suffix(code, 6)
    return count_kmers(reads(spark, sf), 6).select("kmer", src.alias("prefix"), dst.alias("suffix"), dna.edge_code(src, dst).alias("edge"), dna.extend_right(dst, F.lit(2), 6).alias("extended"))


@_register(f"WITH {READS}, w AS (SELECT read_id, substr(sequence, i, 9) AS w FROM (SELECT read_id, sequence, unnest(generate_series(1, length(sequence) - 8)) AS i FROM reads WHERE length(sequence) >= 9)) SELECT read_id, count(*) AS n, CAST(sum({code_sql('w')}) AS BIGINT) AS total, count(DISTINCT w) AS n_different FROM w GROUP BY read_id")
def kmer_windows(spark, sf):
    """All k-mers of each read in order, repeated ones too."""
    each = kmer_arrays(reads(spark, sf), 9).where(F.size("codes") > 0)
    return each.select("read_id", F.size("codes").cast("long").alias("n"), F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.array_distinct("codes")).cast("long").alias("n_different"))


@_register(f"WITH {READS} SELECT read_id, regexp_replace(translate(reverse(sequence), 'ATCG', 'TAGC'), '[^ATCG]', 'N', 'g') AS reverse_bases FROM reads")
def reverse_complement(spark, sf):
    return reads(spark, sf).select("read_id", dna.reverse_complement(F.col("sequence")).alias("reverse_bases"))


@_register(f"WITH {READS} SELECT read_id, CAST(length(sequence) AS INTEGER) AS length, coalesce(round(CAST(length(regexp_replace(sequence, '[^GC]', '', 'g')) AS DOUBLE) / nullif(length(sequence), 0), 9), 0.0) AS gc FROM reads")
def gc_content(spark, sf):
    return reads(spark, sf).select("read_id", F.length("sequence").alias("length"), F.round(dna.gc_content(F.col("sequence")), 9).alias("gc"))


@_register(f"""WITH {READS}, l AS (SELECT length(sequence) AS n, length(regexp_replace(sequence, '[^GC]', '', 'g')) AS gc FROM reads),
c AS (SELECT n, sum(n) OVER (ORDER BY n DESC RANGE UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM l)
SELECT (SELECT count(*) FROM l) AS num_contigs, (SELECT CAST(sum(n) AS BIGINT) FROM l) AS total_bases,
CAST(max(CASE WHEN cum >= 0.5 * total THEN n END) AS INTEGER) AS n50, CAST(max(CASE WHEN cum >= 0.9 * total THEN n END) AS INTEGER) AS n90,
CAST(max(n) AS INTEGER) AS max_length, CAST(min(n) AS INTEGER) AS min_length, round(avg(n), 6) AS avg_length, (SELECT round(sum(gc) / sum(n), 9) FROM l) AS gc_content FROM c""")
def n50_reads(spark, sf):
    out = debruijn.length_stats(reads(spark, sf))
    return out.withColumn("avg_length", F.round("avg_length", 6)).withColumn("gc_content", F.round("gc_content", 9))


# ---- SQL text ----


def _sql(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    sql.register(spark)
    return spark.sql(text, **views)


@_register(f"WITH {kmers_sql(11, 2)} SELECT w AS kmer, kmer AS code, cnt, least(kmer, {code_sql('translate(reverse(w), $$ATCG$$, $$TAGC$$)')}) = kmer AS is_canonical FROM kmers")
def sql_kmers(spark, sf):
    return _sql(spark, """
        SELECT k.kmer, k.code, count(*) AS cnt, k.kmer = k.canonical AS is_canonical
        FROM {reads} AS r, LATERAL kmers(r.sequence, 11, true) AS k
        GROUP BY k.kmer, k.code, k.canonical HAVING count(*) >= 2""", reads=reads(spark, sf))


@_register(f"WITH {SIGNALS}, c AS (SELECT read_id, s, signal[s + 1:s + 20] AS c, s + 20 >= len(signal) AS is_last FROM (SELECT read_id, signal, unnest(range(0, len(signal), 20)) AS s FROM signals)), p AS (SELECT read_id, s, is_last, unnest(c) AS x FROM c), "
           "m AS (SELECT read_id, s, is_last, median(x) AS m, count(*) AS n FROM p GROUP BY ALL) SELECT p.read_id, CAST(p.s AS INTEGER) AS start, CAST(any_value(n) AS INTEGER) AS size, p.is_last, round(any_value(m), 6) AS median, round(median(abs(x - m)), 6) AS mad FROM p JOIN m USING (read_id, s) GROUP BY p.read_id, p.s, p.is_last")
def sql_chunks(spark, sf):
    return _sql(spark, """
        SELECT s.read_id, c.start, c.size, c.is_last, round(signal_median(c.chunk), 6) AS median, round(signal_mad(c.chunk), 6) AS mad
        FROM {signals} AS s, LATERAL signal_chunks(s.signal, 20) AS c""", signals=short_signals(spark, sf))


# ---- graphs ----


@_register(f"WITH {edges_sql(K, LEAST)} SELECT src, dst, cnt FROM edges")
def dbg_edges(spark, sf):
    return graph(spark, sf)


DEGREES = "deg AS (SELECT id, (SELECT count(*) FROM edges WHERE src = id) AS out_degree, (SELECT count(*) FROM edges WHERE dst = id) AS in_degree FROM ends)"


@_register(f"WITH {edges_sql(K, LEAST)}, {DEGREES} SELECT * FROM deg")
def dbg_degrees(spark, sf):
    return debruijn.degrees(graph(spark, sf)).select("id", "out_degree", "in_degree")


@_register(f"WITH {edges_sql(K, LEAST)}, {DEGREES} SELECT 15 AS k, (SELECT count(*) FROM ends) AS num_nodes, count(*) AS num_edges, CAST(sum(cnt) AS BIGINT) AS total_kmer_count, round(avg(cnt), 6) AS avg_kmer_depth, (SELECT max(out_degree + in_degree) FROM deg) AS max_node_degree FROM edges")
def dbg_stats(spark, sf):
    return debruijn.stats(graph(spark, sf), K).withColumn("avg_kmer_depth", F.round("avg_kmer_depth", 6))


@_register(f"WITH {edges_sql(K, LEAST)} SELECT src AS id, count(*) AS n_next, CAST(sum(cnt) AS BIGINT) AS weight, min(dst) AS least_next FROM edges GROUP BY src")
def dbg_neighbors(spark, sf):
    return graph(spark, sf).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_next"), F.sum("cnt").alias("weight"), F.min("dst").alias("least_next"))


@_register(f"WITH {edges_sql(K, LEAST)}, {DEGREES}, gone AS (SELECT id FROM deg WHERE out_degree + in_degree >= 5) SELECT src, dst, cnt FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def dbg_remove_nodes(spark, sf):
    edges = materialize(graph(spark, sf), "graph")
    return debruijn.remove_nodes(edges, debruijn.degrees(edges).where(F.col("out_degree") + F.col("in_degree") >= 5).select("id"))


@_register(f"WITH {edges_sql(K, LEAST)} SELECT src, dst, cnt FROM edges WHERE cnt >= 4")
def dbg_low_coverage_edges(spark, sf):
    return debruijn.low_coverage_edges(graph(spark, sf), 4)


@_register(f"WITH {edges_sql(K, LEAST)}, d AS (SELECT id, avg(cnt) AS depth FROM (SELECT src AS id, cnt FROM edges UNION ALL SELECT dst, cnt FROM edges) GROUP BY id), gone AS (SELECT id FROM d WHERE depth < 3.0) SELECT src, dst, cnt FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def dbg_low_coverage_nodes(spark, sf):
    return debruijn.low_coverage_nodes(materialize(graph(spark, sf), "graph"), 3.0)


@_register(f"WITH {edges_sql(K, LEAST)}, {DEGREES} SELECT id, out_degree - in_degree AS excess FROM deg WHERE out_degree > in_degree")
def dbg_start_nodes(spark, sf):
    return debruijn.start_nodes(graph(spark, sf))


@_register(f"""WITH RECURSIVE {edges_sql(K, LEAST)}, step AS (SELECT src, min(dst) AS dst FROM edges GROUP BY src HAVING count(*) = 1),
walk AS (SELECT src AS id, dst AS node, 1 AS n FROM step UNION ALL SELECT id, step.dst, n + 1 FROM walk JOIN step ON walk.node = src WHERE n < 5)
SELECT DISTINCT id FROM walk WHERE node NOT IN (SELECT src FROM edges)""")
def dbg_tip_starts(spark, sf):
    return debruijn.tip_starts(materialize(graph(spark, sf), "graph"))


@_register(f"""WITH RECURSIVE {edges_sql(31, 3)}, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
r AS (SELECT id AS a, id AS b FROM ends WHERE id NOT IN (SELECT a FROM both_ways WHERE b < a) UNION SELECT r.a, both_ways.b FROM r JOIN both_ways ON r.b = both_ways.a)
SELECT b AS id, min(a) AS component FROM r GROUP BY b""")
def dbg_components(spark, sf):
    return debruijn.components(graph(spark, sf, 31, 3))


@_register(f"""WITH RECURSIVE {edges_sql(K, LEAST)}, step AS (SELECT dst, min(src) AS src FROM edges GROUP BY dst HAVING count(*) = 1),
walk AS (SELECT dst AS id, src AS node, 1 AS n FROM step UNION ALL SELECT id, step.src, n + 1 FROM walk JOIN step ON walk.node = dst WHERE n < 5)
SELECT DISTINCT id FROM walk WHERE node NOT IN (SELECT dst FROM edges)""")
def dbg_tip_ends(spark, sf):
    return debruijn.tip_ends(materialize(graph(spark, sf), "graph"))


@_register(f"WITH {edges_sql(K, LEAST)} SELECT dst AS id, count(*) AS n_before, CAST(sum(cnt) AS BIGINT) AS weight, min(src) AS least_before FROM edges GROUP BY dst")
def dbg_in_neighbors(spark, sf):
    found = debruijn.neighbors(graph(spark, sf), "in")
    total = F.aggregate(F.map_values("neighbors"), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("id", F.size("neighbors").cast("long").alias("n_before"), total.alias("weight"), F.array_min(F.map_keys("neighbors")).alias("least_before"))


@_register(f"WITH {edges_sql(K, LEAST).replace('edges AS (', 'edges AS MATERIALIZED (')} SELECT e.dst AS src, e.src AS dst, coalesce(b.cnt, 0) AS cnt FROM edges e LEFT JOIN edges b ON b.src = e.dst AND b.dst = e.src")
def dbg_edge_counts(spark, sf):
    edges = materialize(graph(spark, sf), "graph")
    return debruijn.edge_counts(edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@_register(f"""WITH {edges_sql(K, LEAST)}, {DEGREES}, gone AS (SELECT id FROM deg WHERE out_degree + in_degree >= 5), kept AS (SELECT src, dst FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone))
SELECT id, id NOT IN (SELECT src FROM kept UNION SELECT dst FROM kept) AS isolated FROM ends WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT -1, true""")
def dbg_node_table(spark, sf):
    edges = materialize(graph(spark, sf), "graph")
    gone = materialize(debruijn.degrees(edges).where(F.col("out_degree") + F.col("in_degree") >= 5).select("id"), "gone")
    known = debruijn.add_nodes(debruijn.drop_nodes(debruijn.nodes(edges), gone), spark.range(1).select(F.lit(-1).cast("long").alias("id")))
    tied = debruijn.nodes(debruijn.remove_nodes(edges, gone)).withColumn("tied", F.lit(True))
    return known.join(tied, "id", "left").select("id", F.col("tied").isNull().alias("isolated"))


@_register(f"WITH {edges_sql(K, LEAST).replace('edges AS (', 'edges AS MATERIALIZED (')} SELECT src, dst, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT src, dst, cnt FROM edges UNION ALL SELECT dst, src, 1 FROM edges WHERE cnt >= 3 UNION ALL SELECT src, dst, 2 FROM edges WHERE cnt < 3) GROUP BY src, dst")
def dbg_add_edges(spark, sf):
    """New edges and more weight of known ones."""
    edges = materialize(graph(spark, sf), "graph")
    back = edges.where("cnt >= 3").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).cast("long").alias("cnt"))
    return debruijn.add_edges(edges, back.unionByName(edges.where("cnt < 3").select("src", "dst", F.lit(2).cast("long").alias("cnt"))))


@_register(f"WITH {edges_sql(K, LEAST)} SELECT src, dst, cnt FROM edges WHERE (src + dst) % 3 > 0")
def dbg_remove_edges(spark, sf):
    """Edges without named ones; edges that are not there may be named too."""
    edges = materialize(graph(spark, sf), "graph")
    named = edges.where("(src + dst) % 3 = 0").select("src", "dst")
    return debruijn.remove_edges(edges, named.unionByName(named.select(F.lit(-1).cast("long").alias("src"), "dst")))


@_register(f"""WITH {edges_sql(K, LEAST).replace('edges AS (', 'edges AS MATERIALIZED (')},
a AS (SELECT src, dst, sum(cnt) AS cnt FROM (SELECT src, dst, cnt FROM edges UNION ALL SELECT dst, src, 1 FROM edges WHERE cnt >= 3) GROUP BY src, dst),
b AS (SELECT * FROM a WHERE (src + dst) % 3 > 0 AND src % 50 <> 0 AND dst % 50 <> 0)
SELECT src, dst, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT * FROM b UNION ALL SELECT src, dst, 5 FROM edges WHERE (src + dst) % 9 = 0) GROUP BY src, dst""")
def dbg_edge_table(spark, sf):
    """Edges added, removed, removed with their nodes and added again, in a bucketed table with a log."""
    edges = materialize(graph(spark, sf), "graph")
    kept = EdgeTable.create(edges)
    kept.add(edges.where("cnt >= 3").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).cast("long").alias("cnt")))
    kept.remove(kept.edges().where("(src + dst) % 3 = 0"))
    kept.remove_nodes(kept.degrees().where("id % 50 = 0"))
    kept.add(edges.where("(src + dst) % 9 = 0").withColumn("cnt", F.lit(5).cast("long")))
    return kept.edges()


def paths_sql(here: str, there: str, starts: str) -> str:
    return f"""WITH RECURSIVE {edges_sql(K, LEAST)}, {DEGREES}, sole AS (SELECT {here} AS a, min({there}) AS b, min(cnt) AS cnt FROM edges GROUP BY {here} HAVING count(*) = 1),
walk AS (SELECT id, id AS node, 0 AS n, CAST(0 AS BIGINT) AS weight FROM deg WHERE {starts} UNION ALL SELECT id, b, n + 1, weight + cnt FROM walk JOIN sole ON node = a WHERE n < 1000 AND (n = 0 OR node <> id))
SELECT id, CAST(max(n) + 1 AS INTEGER) AS n_nodes, arg_max(node, n) AS far_end, max(weight) AS weight FROM walk GROUP BY id"""


def _path_summary(found: DataFrame, far: int) -> DataFrame:
    return found.select("id", F.size("path").alias("n_nodes"), F.element_at("path", far).alias("far_end"), F.aggregate("weights", F.lit(0).cast("long"), lambda a, x: a + x).alias("weight"))


@_register(paths_sql("src", "dst", "out_degree > in_degree"))
def dbg_paths_forward(spark, sf):
    edges = materialize(graph(spark, sf), "graph")
    return _path_summary(debruijn.paths_forward(edges, debruijn.start_nodes(edges)), -1)


@_register(paths_sql("dst", "src", "in_degree > out_degree"))
def dbg_paths_backward(spark, sf):
    edges = materialize(graph(spark, sf), "graph")
    ends = debruijn.degrees(edges).where("in_degree > out_degree").select("id")
    return _path_summary(debruijn.paths_backward(edges, ends), 1)


TIPS = """loose AS (SELECT * FROM edges WHERE src <> dst),
ways AS (SELECT 'back' AS way, src, dst, cnt FROM loose UNION ALL SELECT 'on', dst, src, cnt FROM loose),
tied AS (SELECT way, id, count(*) FILTER (src = id) AS more, count(*) FILTER (dst = id) AS fewer FROM (SELECT *, unnest([src, dst]) AS id FROM ways) GROUP BY way, id),
looped AS (SELECT src AS id FROM edges WHERE src = dst),
sole AS (SELECT way, dst AS place, min(src) AS prev, min(cnt) AS w FROM ways GROUP BY way, dst HAVING count(*) = 1),
walk AS (SELECT way, id AS place, [id] AS path, CAST(0 AS BIGINT) AS weight FROM tied WHERE more = 0 AND fewer > 0 AND id NOT IN (SELECT id FROM looped)
UNION ALL SELECT walk.way, prev, list_prepend(prev, path), weight + w FROM walk JOIN sole ON walk.way = sole.way AND walk.place = sole.place WHERE len(path) < 12 AND NOT list_contains(path, prev)),
ended AS (SELECT walk.* FROM walk LEFT JOIN sole ON walk.way = sole.way AND walk.place = sole.place WHERE prev IS NULL OR list_contains(path, prev)),
tip AS (SELECT path, fewer FROM ended JOIN tied ON ended.way = tied.way AND place = id WHERE len(path) BETWEEN 2 AND 11 AND weight / (len(path) - 1) <= 2.0 AND (fewer = 0 OR more > 1)),
gone AS (SELECT unnest(CASE WHEN fewer = 0 THEN path ELSE path[2:] END) AS id FROM tip)"""


@_register(f"WITH RECURSIVE {edges_sql(31, 2)}, {TIPS} SELECT src, dst, cnt FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def dbg_trim_tips(spark, sf):
    return debruijn.trim_tips(materialize(graph(spark, sf, 31, 2), "graph"))[0]


@_register(f"""WITH RECURSIVE {edges_sql(31, 2).replace("edges AS", "edges AS MATERIALIZED")}, forks AS (SELECT src AS start FROM edges GROUP BY src HAVING count(*) >= 2),
walk AS (SELECT start, dst AS spot, [start, dst] AS path, cnt AS weight, 1 AS n FROM forks JOIN edges ON src = start
 UNION ALL SELECT start, dst, list_append(path, dst), weight + cnt, n + 1
 FROM (SELECT *, bool_or(met) OVER (PARTITION BY start) AS done FROM (SELECT *, count(*) OVER (PARTITION BY start, spot) > 1 AS met FROM walk)) w JOIN edges ON src = spot
 WHERE NOT done AND spot <> start AND n < 100 AND (dst = start OR NOT list_contains(path, dst))),
met AS (SELECT *, count(*) OVER (PARTITION BY start, n, spot) AS c FROM walk), found AS (SELECT * FROM met WHERE c > 1 QUALIFY spot = min(spot) OVER (PARTITION BY start)),
two AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY path) AS side FROM found QUALIFY side <= 2)
SELECT start, any_value(spot) AS "end", CAST(any_value(n) + 1 AS INTEGER) AS nodes, CAST(max(weight) AS BIGINT) AS heavier, CAST(min(weight) AS BIGINT) AS lighter FROM two GROUP BY start""")
def dbg_bubbles(spark, sf):
    found = debruijn.bubbles_of(Pieces.of_reads(reads(spark, sf), 31, 2))
    return found.select("start", "end", F.size(F.col("paths")[0]).alias("nodes"), F.col("weights")[0].alias("heavier"), F.col("weights")[1].alias("lighter"))


@_register()
def dbg_simplify(spark, sf):
    return debruijn.simplify_pieces(Pieces.of_reads(reads(spark, sf), 31, 2))[0].edges()


@_register()
def contigs(spark, sf):
    return debruijn.assemble(reads(spark, sf), 31, 2, 40, path_nodes=False).select("name", "sequence", "length", "num_kmers", F.round("avg_depth", 6).alias("avg_depth"), "is_circular")


@_register()
def contig_stats(spark, sf):
    return debruijn.length_stats(debruijn.assemble(reads(spark, sf), 31, 2, 40, path_nodes=False))


@_register()
def contig_fasta(spark, sf):
    made = debruijn.assemble(reads(spark, sf), 31, 3, 40, path_nodes=False)
    return made.select("name", records.contig_fasta(F.col("name"), F.col("sequence"), F.col("avg_depth"), F.col("is_circular")).alias("record"))


# ---- signals ----


@_register(f"WITH {SHORT} SELECT read_id, CAST(pos AS INTEGER) AS pos, round((value + 10.0) * (1200.0 / 8192.0), 6) AS value FROM points")
def sig_picoamperes(spark, sf):
    raw = short_signals(spark, sf).select("read_id", S.to_picoamperes(F.col("signal"), F.lit(8192.0), F.lit(10.0), F.lit(1200.0)).alias("signal"))
    return signals.long_form(raw).withColumn("value", F.round("value", 6))


MEDIANS = "med AS (SELECT read_id, median(value) AS m FROM points GROUP BY read_id), spread AS (SELECT p.read_id, any_value(m) AS m, CASE WHEN median(abs(value - m)) = 0 THEN 1e-8 ELSE median(abs(value - m)) END AS d FROM points p JOIN med USING (read_id) GROUP BY p.read_id)"


@_register(f"WITH {SHORT}, {MEDIANS} SELECT read_id, round(m, 6) AS median, round(d, 6) AS mad FROM spread")
def sig_median_mad(spark, sf):
    n = short_signals(spark, sf).select("read_id", S.normalize(F.col("signal")).alias("n"))
    return n.select("read_id", F.round("n.median", 6).alias("median"), F.round("n.mad", 6).alias("mad"))


@_register(f"WITH {SHORT}, {MEDIANS} SELECT read_id, CAST(pos AS INTEGER) AS pos, round(greatest(-2.0, least(2.0, (value - m) / (d * 1.4826))), 6) AS value FROM points JOIN spread USING (read_id)")
def sig_normalize_global(spark, sf):
    norm = short_signals(spark, sf).select("read_id", S.normalize(F.col("signal"), 2.0)["norm"].alias("signal"))
    return signals.long_form(norm).withColumn("value", F.round("value", 6))


@_register(f"""WITH {SHORT}, c AS (SELECT read_id, pos, value, pos // 24 AS chunk FROM points), med AS (SELECT read_id, chunk, median(value) AS m FROM c GROUP BY ALL),
spread AS (SELECT c.read_id, c.chunk, any_value(m) AS m, median(abs(value - m)) AS d FROM c JOIN med USING (read_id, chunk) GROUP BY ALL)
SELECT read_id, CAST(pos AS INTEGER) AS pos, round(greatest(-5.0, least(5.0, (value - m) / ((CASE WHEN d = 0 THEN 1e-8 ELSE d END) * 1.4826))), 6) AS value FROM c JOIN spread USING (read_id, chunk)""")
def sig_normalize_chunks(spark, sf):
    norm = short_signals(spark, sf).select("read_id", S.normalize_chunks(F.col("signal"), 24).alias("signal"))
    return signals.long_form(norm).withColumn("value", F.round("value", 6))


@_register(f"""WITH {SHORT}, starts AS (SELECT unnest([0, 10, 20, 30, 40, 44]) AS s), c AS (SELECT read_id, pos, value, s FROM points, starts WHERE pos BETWEEN s AND s + 19),
med AS (SELECT read_id, s, median(value) AS m FROM c GROUP BY ALL),
spread AS (SELECT c.read_id, c.s, any_value(m) AS m, median(abs(value - m)) AS d FROM c JOIN med USING (read_id, s) GROUP BY ALL)
SELECT read_id, CAST(pos AS INTEGER) AS pos, round(avg(greatest(-5.0, least(5.0, (value - m) / ((CASE WHEN d = 0 THEN 1e-8 ELSE d END) * 1.4826)))), 6) AS value FROM c JOIN spread USING (read_id, s) GROUP BY read_id, pos""")
def sig_normalize_windowed(spark, sf):
    return signals.normalize_windowed(short_signals(spark, sf), 20, 10).withColumn("value", F.round("value", 6))


@_register(f"WITH {SHORT} SELECT read_id, CAST(pos AS INTEGER) AS pos, round(value, 5) AS value FROM points")
def sig_denormalize(spark, sf):
    n = short_signals(spark, sf).select("read_id", S.normalize(F.col("signal"), None).alias("n"))
    back = n.select("read_id", S.denormalize(F.col("n.norm"), F.col("n.median"), F.col("n.mad")).alias("signal"))
    return signals.long_form(back).withColumn("value", F.round("value", 5))


@_register(f"WITH {POINTS}, {MEDIANS} SELECT read_id, round(any_value(m), 6) AS median, round(any_value(d), 6) AS mad, round(any_value(d) * 1.4826, 6) AS std_equivalent, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS length FROM points JOIN spread USING (read_id) GROUP BY read_id")
def sig_stats(spark, sf):
    out = signals.stats(long_points(spark, sf))
    return out.select("read_id", *(F.round(c, 6).alias(c) for c in out.columns[1:-1]), "length")


@_register(f"WITH {POINTS} SELECT read_id, CAST(pos AS INTEGER) AS pos, list_sort(w)[len(w) // 2 + 1] AS value FROM (SELECT read_id, pos, list(value) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w FROM points)")
def sig_median_filter(spark, sf):
    return signals.median_filter_points(long_points(spark, sf), 5)


@_register(f"WITH {SHORT} SELECT read_id, CAST(pos AS INTEGER) AS pos, list_sort(w)[len(w) // 2 + 1] AS value FROM (SELECT read_id, pos, list(value) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS w FROM points)")
def sig_median_filter_arrays(spark, sf):
    return signals.long_form(short_signals(spark, sf).select("read_id", S.median_filter(F.col("signal"), 7).alias("signal")))


@_register(f"WITH {SHORT} SELECT read_id, CAST(count(*) FILTER (abs(value) > 0.2) AS INTEGER) AS n_spikes FROM points GROUP BY read_id")
def sig_spike_mask(spark, sf):
    return short_signals(spark, sf).select("read_id", F.size(F.filter(S.spikes(F.col("signal"), 0.2), lambda x: x)).alias("n_spikes"))


@_register(f"""WITH {POINTS}, m AS (SELECT *, abs(value) > 60.0 AS s FROM points), r AS (SELECT *, sum(CASE WHEN s THEN 0 ELSE 1 END) OVER (PARTITION BY read_id ORDER BY pos) AS run FROM m),
z AS (SELECT *, count(*) OVER (PARTITION BY read_id, run, s) AS size, pos - min(pos) OVER (PARTITION BY read_id, run, s) + 1 AS place,
 last_value(CASE WHEN NOT s THEN value END IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
 first_value(CASE WHEN NOT s THEN value END IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM r)
SELECT read_id, CAST(pos AS INTEGER) AS pos, s AS is_spike, round(CASE WHEN s AND size <= 3 AND coalesce(l, r) IS NOT NULL THEN coalesce(l, r) + (coalesce(r, l) - coalesce(l, r)) * place / (size + 1) ELSE value END, 6) AS value FROM z""")
def sig_spike_repair(spark, sf):
    return signals.repair_spikes(long_points(spark, sf), 60.0, 3).withColumn("value", F.round("value", 6))


@_register(f"""WITH {SHORT}, j AS (SELECT a.read_id, a.pos, abs(b.value - a.value) / 8 AS d FROM points a JOIN points b ON a.read_id = b.read_id AND b.pos = a.pos + 8),
best AS (SELECT read_id, max(d) AS d FROM j GROUP BY read_id), place AS (SELECT j.read_id, min(j.pos) AS p, any_value(best.d) AS d FROM j JOIN best ON j.read_id = best.read_id AND j.d = best.d GROUP BY j.read_id)
SELECT read_id, CAST(CASE WHEN d < 0.05 THEN 4 ELSE greatest(p + 4, 4) END AS INTEGER) AS position FROM place""")
def sig_trim_adapter(spark, sf):
    return short_signals(spark, sf).select("read_id", S.trim_position(F.col("signal"), 8, 0.05, 4).alias("position"))


@_register(f"""WITH {POINTS}, near AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS island FROM points WHERE abs(value - 20.0) < 18.0)
SELECT read_id, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + 1 AS INTEGER) AS "end" FROM near GROUP BY read_id, island HAVING max(pos) + 1 - min(pos) >= 3""")
def sig_open_pore(spark, sf):
    return signals.regions(long_points(spark, sf), 20.0, 18.0, 3)


@_register(f"WITH {POINTS} SELECT read_id, CAST(pos AS INTEGER) AS pos, round(stddev_pop(value) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 5) AS value FROM points")
def sig_running_std(spark, sf):
    return signals.running_std(long_points(spark, sf), 10).withColumn("value", F.round("value", 5))


@_register(f"WITH {SIGNALS} SELECT read_id, CAST(s AS INTEGER) AS start, CAST(len(signal[s + 1:s + 20]) AS INTEGER) AS size, round(list_sum(signal[s + 1:s + 20]), 6) AS total FROM (SELECT read_id, signal, unnest(range(0, len(signal), 20)) AS s FROM signals)")
def sig_chunks(spark, sf):
    c = short_signals(spark, sf).select("read_id", F.explode(S.chunks(F.col("signal"), 20)).alias("c"))
    return c.select("read_id", "c.start", F.size("c.chunk").alias("size"), F.round(F.aggregate("c.chunk", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@_register(f"""WITH {READS}, numbered AS (SELECT read_id, CAST(least(length(sequence), 50) AS INTEGER) AS length, (row_number() OVER (ORDER BY read_id) - 1) // 32 AS batch_id FROM reads WHERE length(sequence) > 0)
SELECT batch_id, read_id, length, max(length) OVER (PARTITION BY batch_id) AS padded FROM numbered""")
def sig_batch_pad(spark, sf):
    labels = reads(spark, sf).where(F.length("sequence") > 0).select("read_id", dna.labels_of_bases(F.col("sequence")).cast("array<double>").alias("signal"))
    return signals.padded_batches(labels, 32, 50).select("batch_id", "read_id", "length", F.size("signal").alias("padded"))


@_register(f"""WITH {READS}, numbered AS (SELECT read_id, CAST(length(sequence) AS INTEGER) AS length, (row_number() OVER (ORDER BY read_id) - 1) // 32 AS batch_id FROM reads WHERE length(sequence) > 0)
SELECT batch_id, read_id, length, max(length) OVER (PARTITION BY batch_id) AS padded FROM numbered""")
def sig_batch_lengths(spark, sf):
    whole = reads(spark, sf).where(F.length("sequence") > 0).select("read_id", F.length("sequence").alias("length"))
    return signals.batch_lengths(whole, 32)


DENOISED = f"""{SHORT}, f AS (SELECT read_id, pos, list_sort(w)[len(w) // 2 + 1] AS value FROM (SELECT read_id, pos, list(value) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w FROM points)),
m AS (SELECT *, abs(value) > 0.15 AS s FROM f), r AS (SELECT *, sum(CASE WHEN s THEN 0 ELSE 1 END) OVER (PARTITION BY read_id ORDER BY pos) AS run FROM m),
z AS (SELECT *, count(*) OVER (PARTITION BY read_id, run, s) AS size, pos - min(pos) OVER (PARTITION BY read_id, run, s) + 1 AS place,
 last_value(CASE WHEN NOT s THEN value END IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
 first_value(CASE WHEN NOT s THEN value END IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM r)"""
DENOISER = signals.Denoiser(5, 0.15, 3)


@_register(f"WITH {DENOISED} SELECT read_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN s AND size <= 3 AND coalesce(l, r) IS NOT NULL THEN coalesce(l, r) + (coalesce(r, l) - coalesce(l, r)) * place / (size + 1) ELSE value END, 6) AS value FROM z")
def sig_denoise(spark, sf):
    return signals.long_form(signals.denoise(short_signals(spark, sf), DENOISER)).withColumn("value", F.round("value", 6))


@_register(f"WITH {DENOISED} SELECT read_id, true AS median_filter_applied, bool_or(s) AS spikes_removed, CAST(count(*) FILTER (s) AS INTEGER) AS n_spike_samples, round(avg(CASE WHEN s THEN 1.0 ELSE 0.0 END), 9) AS spike_fraction FROM z GROUP BY read_id")
def sig_denoise_stats(spark, sf):
    return signals.denoise(short_signals(spark, sf), DENOISER).select("read_id", "stats.*").withColumn("spike_fraction", F.round("spike_fraction", 9))


@_register(f"""WITH {SHORT}, {MEDIANS}, n AS (SELECT read_id, pos, greatest(-5.0, least(5.0, (value - m) / (d * 1.4826))) AS value FROM points JOIN spread USING (read_id)),
j AS (SELECT a.read_id, a.pos, abs(b.value - a.value) / 8 AS d FROM n a JOIN n b ON a.read_id = b.read_id AND b.pos = a.pos + 8), best AS (SELECT read_id, max(d) AS d FROM j GROUP BY read_id),
place AS (SELECT j.read_id, min(j.pos) AS p, any_value(best.d) AS d FROM j JOIN best ON j.read_id = best.read_id AND j.d = best.d GROUP BY j.read_id),
c AS (SELECT n.read_id, pos - p AS pos, value FROM n JOIN (SELECT read_id, CASE WHEN d < 0.05 THEN 4 ELSE greatest(p + 4, 4) END AS p FROM place) q USING (read_id) WHERE pos >= p)
SELECT read_id, CAST(pos AS INTEGER) AS pos, round(list_sort(w)[len(w) // 2 + 1], 6) AS value FROM (SELECT read_id, pos, list(value) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w FROM c)""")
def sig_preprocess(spark, sf):
    out = signals.preprocess(short_signals(spark, sf), trim_window=8, trim_threshold=0.05, min_trim=4)
    return signals.long_form(out).withColumn("value", F.round("value", 6))


# ---- signals in segments ----

#: Samples of a segment in these queries; far below the library's default, so that these tables have several for each user.
SEGMENT = 32


def event_points(spark: SparkSession, sf: str) -> DataFrame:
    """`long_points`, numbered without bringing a user's rows together."""
    rows = table(spark, sf, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("read_id"), "ts", "event_id", "value")
    return number_within(rows, "read_id", "ts", "event_id").select("read_id", "pos", "value")


def event_segments(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(segments.of_points(event_points(spark, sf), SEGMENT), "segments")


@_register(ORACLES["sig_stats"])
def sig_stats_selected(spark, sf):
    out = signals.stats(materialize(event_points(spark, sf), "points"), gathered=0)
    return out.select("read_id", *(F.round(c, 6).alias(c) for c in out.columns[1:-1]), "length")


@_register(f"WITH {POINTS} SELECT read_id, CAST(s AS BIGINT) AS start, CAST(count(*) AS INTEGER) AS size, round(sum(value), 6) AS total FROM (SELECT *, pos - pos % {SEGMENT} AS s FROM points) GROUP BY read_id, s")
def seg_chunks(spark, sf):
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return event_segments(spark, sf).select("read_id", "start", F.size("values").alias("size"), F.round(total, 6).alias("total"))


@_register(ORACLES["sig_median_filter"])
def seg_median_filter(spark, sf):
    out = segments.to_points(segments.median_filter(event_segments(spark, sf), 5, SEGMENT))
    return out.withColumn("pos", F.col("pos").cast("int"))


@_register(ORACLES["sig_running_std"])
def seg_running_std(spark, sf):
    out = segments.running_std(event_segments(spark, sf), 10, SEGMENT)
    return out.select("read_id", F.col("pos").cast("int").alias("pos"), F.round("value", 5).alias("value"))


@_register(ORACLES["sig_spike_repair"])
def seg_spike_repair(spark, sf):
    out = segments.repair_spikes(event_segments(spark, sf), 60.0, 3, SEGMENT)
    return out.select("read_id", F.col("pos").cast("int").alias("pos"), "is_spike", F.round("value", 6).alias("value"))


@_register(ORACLES["sig_open_pore"])
def seg_open_pore(spark, sf):
    out = segments.regions(event_segments(spark, sf), 20.0, 18.0, 3)
    return out.select("read_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@_register(f"""WITH {POINTS}, n AS (SELECT read_id, count(*) AS n FROM points GROUP BY read_id), j AS (SELECT a.read_id, a.pos, abs(b.value - a.value) / 8 AS d FROM points a JOIN points b ON a.read_id = b.read_id AND b.pos = a.pos + 8),
best AS (SELECT read_id, max(d) AS d FROM j GROUP BY read_id), place AS (SELECT j.read_id, min(j.pos) AS p, any_value(best.d) AS d FROM j JOIN best ON j.read_id = best.read_id AND j.d = best.d GROUP BY j.read_id),
found AS (SELECT read_id, n, CASE WHEN n < 16 THEN 0 WHEN d < 1.0 THEN 4 ELSE greatest(p + 4, 4) END AS p FROM n LEFT JOIN place USING (read_id)), cut AS (SELECT read_id, CASE WHEN p >= n AND n >= 16 THEN 4 ELSE p END AS p FROM found)
SELECT read_id, pos - p AS pos, value FROM points JOIN cut USING (read_id) WHERE pos >= p""")
def seg_trim(spark, sf):
    whole = event_segments(spark, sf)
    return segments.to_points(segments.trim(whole, segments.trim_position(whole, 8, 1.0, 4, SEGMENT), SEGMENT))


@_register(f"WITH {POINTS}, {MEDIANS} SELECT read_id, pos, round(greatest(-5.0, least(5.0, (value - m) / (d * 1.4826))), 6) AS value FROM points JOIN spread USING (read_id)")
def seg_normalize(spark, sf):
    return segments.to_points(segments.normalize(event_segments(spark, sf), 5.0, gathered=0)).withColumn("value", F.round("value", 6))


# ---- decoding ----

LP = f"""{SIGNALS}, z AS (SELECT read_id, t, list_transform(signal[t * 5 + 1:t * 5 + 5], lambda x: x * 10) AS row FROM (SELECT read_id, list_append(signal, 0.0) AS signal FROM signals), (SELECT unnest(range(13)) AS t)),
best AS (SELECT read_id, t, row, list_position(row, list_max(row)) - 1 AS label, ln(list_sum(list_transform(row, lambda x: exp(x - list_max(row))))) + list_max(row) AS total FROM z),
flag AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY read_id ORDER BY t) THEN 0 ELSE 1 END AS new FROM best),
run AS (SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY t) AS run FROM flag),
runs AS (SELECT read_id, run, any_value(label) AS label, min(t) AS s, max(t) AS e, avg(exp(row[label + 1] - total)) AS conf, arg_min(exp(row[label + 1] - total), t) AS peak FROM run WHERE label <> 4 GROUP BY read_id, run)"""


@_register(f"WITH {LP} SELECT v.vec_id AS read_id, coalesce(string_agg(substr('ATCG', runs.label + 1, 1), '' ORDER BY s), '') AS sequence, round(coalesce(avg(peak), 0.0), 6) AS confidence FROM embeddings v LEFT JOIN runs ON runs.read_id = v.vec_id GROUP BY v.vec_id")
def ctc_greedy(spark, sf):
    out = basecall.decode(log_probs(spark, sf))
    return out.select("read_id", "sequence", F.round("peak_confidence", 6).alias("confidence"))


@_register(f"""WITH {SIGNALS}, z AS (SELECT read_id, t, list_transform(signal[t * 4 + 1:t * 4 + 4], lambda x: x * 10) AS row FROM signals, (SELECT unnest(range(16)) AS t) WHERE t < read_id % 17),
best AS (SELECT read_id, t, list_position(row, list_max(row)) - 1 AS label, exp(-ln(list_sum(list_transform(row, lambda x: exp(x - list_max(row)))))) AS p FROM z),
flag AS (SELECT *, label <> 3 AND (t = 0 OR label <> lag(label) OVER (PARTITION BY read_id ORDER BY t)) AS new FROM best),
found AS (SELECT read_id, count(*) AS n, avg(p) AS p, string_agg(CAST(label AS VARCHAR), '' ORDER BY t) AS labels, string_agg(substr('ATC', CAST(label AS INTEGER) + 1, 1), '' ORDER BY t) AS sequence FROM flag WHERE new GROUP BY read_id)
SELECT v.vec_id AS read_id, CAST(coalesce(n, 0) AS INTEGER) AS n_labels, rpad(coalesce(labels, ''), CAST((SELECT max(n) FROM found) AS INTEGER), '3') AS labels, coalesce(sequence, '') AS sequence, round(coalesce(p, 0.0), 6) AS confidence
FROM embeddings v LEFT JOIN found ON found.read_id = v.vec_id""")
def ctc_padded(spark, sf):
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: ctc.log_softmax(F.transform(F.slice("signal", t * 4 + 1, F.lit(4)), lambda x: x * 10)))
    lp = short_signals(spark, sf).select("read_id", rows.alias("lp"), (F.col("read_id") % 17).cast("int").alias("steps"))
    padded = materialize(basecall.decode_padded(lp, basecall.GreedyDecoder(3, "ATC"), "steps"), "padded")
    out = padded.join(basecall.padded_to_sequence(padded, "ATC"), "read_id")
    return out.select("read_id", "n_labels", F.array_join(F.col("labels").cast("array<string>"), "").alias("labels"), "sequence", F.round("confidence", 6).alias("confidence"))


@_register(f"WITH {LP} SELECT read_id, CAST(label AS INTEGER) AS label, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\" FROM runs")
def ctc_timesteps(spark, sf):
    return log_probs(spark, sf).select("read_id", F.explode(ctc.runs(F.col("lp"))).alias("r")).select("read_id", "r.label", "r.start", "r.end")


@_register(f"WITH {LP} SELECT read_id, CAST(row_number() OVER (PARTITION BY read_id ORDER BY s) - 1 AS INTEGER) AS k, round(conf, 6) AS confidence, round(-10.0 * log10(least(greatest(1 - least(greatest(conf, 1e-10), 1 - 1e-10), 1e-10), 1.0)), 5) AS quality FROM runs")
def ctc_quality(spark, sf):
    out = basecall.decode(log_probs(spark, sf)).select("read_id", F.posexplode(F.arrays_zip("confidences", "quality_scores")).alias("k", "z"))
    return out.select("read_id", "k", F.round("z.confidences", 6).alias("confidence"), F.round("z.quality_scores", 5).alias("quality"))


@_register(f"WITH {READS} SELECT read_id, CAST(length(sequence) AS INTEGER) AS n_labels, CAST(length(regexp_replace(sequence, '[^TG]', '', 'g')) + 2 * length(regexp_replace(sequence, '[^CG]', '', 'g')) AS BIGINT) AS total FROM reads")
def bases_to_labels(spark, sf):
    labels = dna.labels_of_bases(F.col("sequence"))
    return reads(spark, sf).select("read_id", F.size(labels).alias("n_labels"), F.aggregate(labels, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@_register("""WITH l AS (SELECT vec_id AS read_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 6) AS l FROM embeddings)
SELECT read_id, list_aggregate(list_transform(list_filter(l, lambda x: x < 4), lambda x: substr('ATCG', x + 1, 1)), 'string_agg', '') AS dropped,
list_aggregate(list_transform(l, lambda x: CASE WHEN x < 4 THEN substr('ATCG', x + 1, 1) ELSE 'N' END), 'string_agg', '') AS marked FROM l""")
def labels_to_bases(spark, sf):
    l = table(spark, sf, "embeddings").select(F.col("vec_id").alias("read_id"), F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 6).cast("int")).alias("l"))
    return l.select("read_id", dna.bases_of_labels(F.col("l"), "drop").alias("dropped"), dna.bases_of_labels(F.col("l"), "N").alias("marked"))


@_register(f"WITH {READS} SELECT read_id, '>' || read_id || CASE WHEN read_id % 5 > 0 THEN ' mean_q=' || printf('%.3f', (read_id % 5) / 5.0) ELSE '' END || chr(10) || sequence AS record FROM reads")
def fasta_records(spark, sf):
    return reads(spark, sf).select("read_id", records.fasta(F.col("read_id").cast("string"), F.col("sequence"), F.col("read_id") % 5 / 5.0).alias("record"))


@_register(f"""WITH {READS} SELECT read_id, '@' || read_id || chr(10) || sequence || chr(10) || '+' || chr(10) || CASE WHEN read_id % 3 = 0 THEN repeat('I', length(sequence))
ELSE coalesce(list_aggregate(list_transform(CASE WHEN sequence = '' THEN [] ELSE string_split(sequence, '') END, lambda c: CASE c WHEN 'A' THEN '!' WHEN 'T' THEN '2' WHEN 'C' THEN 'C' ELSE 'I' END), 'string_agg', ''), '') END AS record FROM reads""")
def fastq_records(spark, sf):
    scores = F.transform(dna.labels_of_bases(F.col("sequence")), lambda x: x * 17.0)
    return reads(spark, sf).select("read_id", records.fastq(F.col("read_id").cast("string"), F.col("sequence"), F.when(F.col("read_id") % 3 != 0, scores)).alias("record"))


@_register(f"WITH {READS} SELECT CAST(read_id AS VARCHAR) AS read_id, CASE WHEN read_id % 5 > 0 THEN 'mean_q=' || printf('%.3f', (read_id % 5) / 5.0) ELSE '' END AS description, sequence FROM reads")
def fasta_round_trip(spark, sf):
    """Every read written as FASTA by Spark, and read again."""
    path = f"{shared_dir(spark).rstrip('/')}/fasta-{uuid.uuid4().hex}"
    fasta.write_records(fasta_records(spark, sf), path)
    return fasta.read_fasta(spark, path)


@_register(f"WITH {READS} SELECT read_id, sequence, CAST(length(sequence) AS INTEGER) AS n_scores, CAST(coalesce(list_sum(list_transform(string_split(sequence, ''), lambda c: CASE WHEN c = '' THEN 0 WHEN read_id % 3 = 0 THEN 40 ELSE 17 * (strpos('ATCG', c) - 1) - CASE WHEN c = 'G' THEN 11 ELSE 0 END END)), 0) AS BIGINT) AS total FROM reads")
def fastq_round_trip(spark, sf):
    """Every read written as numbered FASTQ parts by the sink, and read again."""
    path = f"{shared_dir(spark).rstrip('/')}/fastq-{uuid.uuid4().hex}"
    records_sink.write_file(fastq_records(spark, sf), path, single=False, extension=".fastq")
    back = fasta.read_fastq(spark, path)
    total = F.aggregate("quality_scores", F.lit(0).cast("long"), lambda a, x: a + x)
    return back.select(F.col("read_id").cast("long").alias("read_id"), "sequence", F.size("quality_scores").alias("n_scores"), total.alias("total"))


@_register(f"WITH {READS} SELECT read_id, CAST((((length(sequence) + 1) // 2 + 1) // 2 + 1) // 2 AS INTEGER) AS steps FROM reads")
def net_output_length(spark, sf):
    return reads(spark, sf).select("read_id", network.output_length(F.length("sequence")).alias("steps"))


SMALL_NET = network.NetConfig(conv_channels=(8, 16), kernels=(5, 5), strides=(2, 1), gru_hidden=16, gru_layers=1)


def _mass(lp: DataFrame) -> DataFrame:
    """Steps and the sum of all probabilities, which must be the number of steps."""
    return lp.select("read_id", F.size("lp").alias("steps"), F.round(F.aggregate("lp", F.lit(0.0), lambda a, r: a + F.aggregate(r, F.lit(0.0), lambda b, x: b + F.exp(x))), 3).alias("mass"))


@_register(f"WITH {SIGNALS} SELECT read_id, CAST((len(signal) + 1) // 2 AS INTEGER) AS steps, CAST((len(signal) + 1) // 2 AS DOUBLE) AS mass FROM signals")
def basecall_logits(spark, sf):
    return _mass(network.infer(short_signals(spark, sf), network.random_weights(SMALL_NET), SMALL_NET))


@_register(f"WITH {POINTS}, c AS (SELECT read_id, pos // 512 AS part, count(*) AS n FROM points GROUP BY ALL) SELECT read_id, part, CAST((n + 1) // 2 AS INTEGER) AS steps, CAST((n + 1) // 2 AS DOUBLE) AS mass FROM c")
def basecall_events(spark, sf):
    """The network over a user's events in chunks of at most 512: signals of many lengths in one pass."""
    parts = segments.of_points(event_points(spark, sf), 512)
    lp = network.infer(parts.select(F.struct("read_id", F.col("segment").alias("part")).alias("read_id"), F.col("values").alias("signal")), network.random_weights(SMALL_NET), SMALL_NET)
    return _mass(lp).select("read_id.read_id", "read_id.part", "steps", "mass")


def _calls(spark, sf):
    return basecall.basecall(short_signals(spark, sf), network.random_weights(SMALL_NET), SMALL_NET, trim_window=8, trim_threshold=0.05, min_trim=4)


@_register()
def basecall_pipeline(spark, sf):
    return _calls(spark, sf).select("read_id", "sequence", F.round("mean_confidence", 4).alias("mean_confidence"), "signal_length", "sequence_length", "num_bases")


@_register()
def basecall_summary(spark, sf):
    return basecall.summary(_calls(spark, sf)).select("num_reads", "total_bases", "total_samples", F.round("avg_length", 4).alias("avg_length"), F.round("avg_confidence", 4).alias("avg_confidence"))


@_register()
def stream_basecalls(spark, sf):
    as_reads = lambda rows: rows.select(F.col("vec_id").alias("read_id"), F.col("embedding").cast("array<double>").alias("signal"))
    table(spark, sf, "embeddings")
    out = basecall_available(spark, f"{sf}/embeddings*.parquet", network.random_weights(SMALL_NET), SMALL_NET, reads=as_reads, trim_window=8, trim_threshold=0.05, min_trim=4)
    return out.select("read_id", "sequence", F.round("mean_confidence", 4).alias("mean_confidence"), "signal_length", "num_bases")


@_register(f"WITH {SHORT}, {MEDIANS} SELECT read_id, round(m, 6) AS median, round(d, 6) AS mad FROM spread")
def stream_signal_summary(spark, sf):
    def step(rows: DataFrame) -> DataFrame:
        n = rows.select(F.col("vec_id").alias("read_id"), S.normalize(F.col("embedding").cast("array<double>")).alias("n"))
        return n.select("read_id", F.round("n.median", 6).alias("median"), F.round("n.mad", 6).alias("mad"))

    table(spark, sf, "embeddings")
    return run_available(spark, f"{sf}/embeddings*.parquet", step)
