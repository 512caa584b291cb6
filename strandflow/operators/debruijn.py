"""De Bruijn graphs as edge tables (src, dst, cnt) and node tables (id)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import dna, records
from strandflow.operators.kmers import count_kmers
from strandflow.operators.pieces import Pieces
from strandflow.plans.numbering import number_rows
from strandflow.session import materialize
from strandflow.sources.fasta import write_records


def edges_of_kmers(kmers: DataFrame, k: int) -> DataFrame:
    """One edge for each k-mer, from its prefix to its suffix."""
    code = F.col("kmer")
    return kmers.select(dna.prefix(code).alias("src"), dna.suffix(code, k).alias("dst"), "cnt")


def build(reads: DataFrame, k: int, min_count: int = 1) -> DataFrame:
    return edges_of_kmers(count_kmers(reads, k, min_count), k)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def add_nodes(known: DataFrame, more: DataFrame) -> DataFrame:
    """Node table (id) with the ids of `more`; a node table also holds nodes without edges."""
    return known.select("id").unionByName(more.select("id")).distinct()


def drop_nodes(known: DataFrame, gone: DataFrame) -> DataFrame:
    return known.join(gone.select("id"), "id", "left_anti")


def edge_counts(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, cnt) of the pairs (src, dst); 0 where there is no edge."""
    return pairs.select("src", "dst").join(edges, ["src", "dst"], "left").select("src", "dst", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def neighbors(edges: DataFrame, side: str = "out") -> DataFrame:
    """(id, neighbors): map from each node that follows (side `out`) or comes before (`in`) to the edge's weight."""
    here, there = ("src", "dst") if side == "out" else ("dst", "src")
    return edges.groupBy(F.col(here).alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(there), F.col("cnt")))).alias("neighbors"))


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.unionByName(more).groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def remove_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that touch a node of `gone` (id)."""
    return edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "cnt")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, out_loose, in_loose): the latter two without self-loops. One shuffle."""
    other = (F.col("src") != F.col("dst")).cast("long")
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), other.alias("ol"), F.lit(0).cast("long").alias("il")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).cast("long").alias("ol"), other.alias("il")),
    )).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("ol").alias("out_loose"), F.sum("il").alias("in_loose"))


def stats(edges: DataFrame, k: int) -> DataFrame:
    per_edge = edges.agg(F.count("*").alias("num_edges"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_kmer_count"), F.coalesce(F.avg("cnt"), F.lit(0.0)).alias("avg_kmer_depth"))
    per_node = degrees(edges).agg(F.count("*").alias("num_nodes"), F.coalesce(F.max(F.col("out_degree") + F.col("in_degree")), F.lit(0)).alias("max_node_degree"))
    return per_edge.join(per_node, how="cross").select(F.lit(k).alias("k"), "num_nodes", "num_edges", "total_kmer_count", "avg_kmer_depth", "max_node_degree")


def low_coverage_edges(edges: DataFrame, min_count: int = 2) -> DataFrame:
    return edges.where(F.col("cnt") >= min_count)


def node_depths(edges: DataFrame) -> DataFrame:
    """(id, depth): mean weight of incident edges; a self-loop counts twice."""
    both = edges.select(F.col("src").alias("id"), "cnt").unionByName(edges.select(F.col("dst").alias("id"), "cnt"))
    return both.groupBy("id").agg(F.avg("cnt").alias("depth"))


def low_coverage_nodes(edges: DataFrame, min_depth: float = 1.0) -> DataFrame:
    return remove_nodes(edges, node_depths(edges).where(F.col("depth") < min_depth))


def start_nodes(edges: DataFrame) -> DataFrame:
    """(id, excess): nodes with more edges out than in."""
    d = degrees(edges).select("id", (F.col("out_degree") - F.col("in_degree")).alias("excess"))
    return d.where("excess > 0")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of each node; component: its least node. Only ends of pieces meet in rounds."""
    return Pieces.of(edges).components()


def tip_starts(edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """(id) of nodes whose only way on reaches an end within max_depth steps."""
    only = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst"))
    step = only.where("n = 1").select(F.col("src").alias("at"), "dst")
    ends = nodes(edges).join(only.select(F.col("src").alias("id")), "id", "left_anti").select(F.col("id").alias("at"))
    now = step.select(F.col("at").alias("id"), F.col("dst").alias("at"))
    done = None
    for _ in range(max_depth):
        hit = now.join(ends, "at", "left_semi").select("id")
        done = hit if done is None else done.unionByName(hit)
        now = now.join(step, "at").select("id", F.col("dst").alias("at"))
    return done.distinct()


def tip_ends(edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """(id) of nodes whose only way back reaches a beginning within max_depth steps."""
    return tip_starts(_reversed(edges), max_depth)


def paths_forward(edges: DataFrame, starts: DataFrame, max_length: int = 1000) -> DataFrame:
    """(id, path, weights): from each start (id) along only ways on, at most max_length edges, to a fork or end or back at the start.

    Jumps of 1, 2, 4, ... edges are joined from themselves, and each start's positions unfold from
    them, so the rounds grow with the logarithm of max_length.
    """
    only = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst"), F.min("cnt").alias("cnt")).where("n = 1")
    only = materialize(only.select(F.col("src").alias("node"), "dst", "cnt"), "only-on")
    jumps = [only.select("node", "dst")]
    while 2 ** len(jumps) <= max_length:
        half = jumps[-1]
        jumps.append(materialize(half.select("node", F.col("dst").alias("mid")).join(half.withColumnRenamed("node", "mid"), "mid").select("node", "dst"), "jumps"))
    # starts may cost a pass over all edges, so they are made once; a round writes only what it adds
    places = materialize(starts.select("id", F.lit(0).alias("place"), F.col("id").alias("node")), "path-starts")
    for k in reversed(range(len(jumps))):
        further = places.join(jumps[k], "node").select("id", (F.col("place") + 2**k).alias("place"), F.col("dst").alias("node"))
        places = places.unionByName(materialize(further.where(F.col("place") <= max_length), "path-places"))
    closed = places.where("place > 0 AND node = id").groupBy("id").agg(F.min("place").alias("last"))
    kept = places.join(closed, "id", "left").where("last IS NULL OR place <= last").join(only, "node", "left")
    steps = F.sort_array(F.collect_list(F.struct("place", "node", "cnt")))
    found = kept.groupBy("id").agg(steps.alias("steps"))
    return found.select("id", F.col("steps.node").alias("path"), F.slice(F.col("steps.cnt"), F.lit(1), F.size("steps") - 1).alias("weights"))


def paths_backward(edges: DataFrame, ends: DataFrame, max_length: int = 1000) -> DataFrame:
    """(id, path, weights): as `paths_forward` on only ways back; nodes in forward order, weights in the order of the walk."""
    return paths_forward(_reversed(edges), ends, max_length).withColumn("path", F.reverse("path"))


@dataclass(frozen=True)
class Simplification:
    tip_max_length: int = 10
    tip_min_depth: float = 2.0
    bubble_max_length: int = 100
    max_iterations: int = 10


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cnt")


def _ends(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, out_loose, in_loose, back, back_cnt, on, on_cnt): as `degrees`, with the least node before and after, loops aside."""
    other = F.col("src") != F.col("dst")
    none, loose = F.lit(0).cast("long"), F.when(other, F.col("cnt"))
    one = lambda here, there, o, i, prev: F.struct(
        F.col(here).alias("id"), F.lit(o).alias("o"), F.lit(i).alias("i"), (other.cast("long") if o else none).alias("ol"), (other.cast("long") if i else none).alias("il"),
        *((F.when(other, F.col(there)) if name == prev else F.lit(None).cast("long")).alias(name) for name in ("back", "on")),
        *((loose if name == prev else F.lit(None).cast("long")).alias(f"{name}_cnt") for name in ("back", "on")))
    ends = edges.select(F.explode(F.array(one("src", "dst", 1, 0, "on"), one("dst", "src", 0, 1, "back"))).alias("e")).select("e.*")
    sums = (F.sum(c).alias(n) for c, n in (("o", "out_degree"), ("i", "in_degree"), ("ol", "out_loose"), ("il", "in_loose")))
    return ends.groupBy("id").agg(*sums, *(F.min(c).alias(c) for c in ("back", "back_cnt", "on", "on_cnt")))


def _tips(known: DataFrame, conf: Simplification) -> DataFrame:
    """(seed, path) of low, short chains that end at a node without out-edges (they are walked back), or in-edges (walked on).

    A walk goes on while there is exactly one other node before it; all walks move in step, one join a level, until they are
    longer than any tip. known: `_ends` in buckets of id, so only walks are exchanged.
    """
    back = F.col("back_way")
    seeds = [known.where(none).where(some).select(F.lit(way).alias("back_way"), "id") for way, none, some in ((True, "out_degree = 0", "in_loose > 0"), (False, "in_degree = 0", "out_loose > 0"))]
    walk = seeds[0].unionByName(seeds[1]).select("back_way", F.col("id").alias("seed"), "id", F.array("id").alias("path"), F.lit(0).cast("long").alias("weight"))
    finished = None
    for _ in range(conf.tip_max_length + 1):
        more, fewer = F.when(back, F.col("out_loose")).otherwise(F.col("in_loose")), F.when(back, F.col("in_loose")).otherwise(F.col("out_loose"))
        prev, w = (F.when(fewer == 1, F.when(back, F.col(b)).otherwise(F.col(o))) for b, o in (("back", "on"), ("back_cnt", "on_cnt")))
        walk = materialize(walk.join(known, "id").select("back_way", "seed", "id", "path", "weight", more.alias("more"), fewer.alias("fewer"), prev.alias("prev"), w.alias("w")), "tip-walk")
        stop = F.col("prev").isNull() | F.array_contains("path", F.coalesce("prev", F.lit(-1).cast("long")))
        ended = walk.where(stop).select("seed", "path", "weight", "more", "fewer")
        finished = ended if finished is None else finished.unionByName(ended)
        walk = walk.where(~stop).select("back_way", "seed", F.col("prev").alias("id"), F.concat("path", F.array("prev")).alias("path"), (F.col("weight") + F.col("w")).alias("weight"))
    size = F.size("path")
    fit = finished.where((size > 1) & (size - 1 <= conf.tip_max_length) & (F.col("weight") / (size - 1) <= conf.tip_min_depth))
    return fit.where("fewer = 0 OR more > 1").select("seed", F.when(F.col("fewer") == 0, F.col("path")).otherwise(F.slice("path", 1, F.size("path") - 1)).alias("path"))


def trim_tips(edges: DataFrame, conf: Simplification = Simplification()) -> tuple[DataFrame, DataFrame]:
    """Edges without tips, and the tips removed (seed, path). All decisions are made on the graph as given."""
    spark, name = edges.sparkSession, f"ends_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _ends(edges).repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").format("parquet").saveAsTable(name)
    tips = materialize(_tips(spark.table(name), conf), "tips")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    gone = tips.select(F.explode("path").alias("id")).distinct()
    return remove_nodes(edges, gone), tips


def stretches(edges: DataFrame, max_length: int = 100) -> DataFrame:
    """(head, via, place, src, node, cnt): the forced ways on, place 1, 2, ... along each, cnt of the edge from src to node.

    A stretch begins with any edge out of a junction (a node without exactly one edge in and one out) and goes on to the next
    junction, or for max_length edges. Jumps of 1, 2, 4, ... edges over inner nodes unfold it, so its rounds
    grow with the logarithm of max_length, and an edge is a row of one stretch.
    """
    inner = degrees(edges).where("out_degree = 1 AND in_degree = 1").select(F.col("id").alias("node"))
    inner = materialize(inner, "inner-nodes")
    on = materialize(edges.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("node"), "dst", "cnt"), "inner-steps")
    jumps = [on.select("node", "dst")]
    while 2 ** len(jumps) < max_length:
        half = jumps[-1]
        jumps.append(materialize(half.select("node", F.col("dst").alias("mid")).join(half.withColumnRenamed("node", "mid"), "mid").select("node", "dst"), "jumps"))
    first = edges.join(inner.withColumnRenamed("node", "src"), "src", "left_anti")
    places = first.select(F.col("src").alias("head"), F.col("dst").alias("via"), F.lit(1).alias("place"), F.col("dst").alias("node"))
    for k in reversed(range(len(jumps))):
        further = places.join(jumps[k], "node").select("head", "via", (F.col("place") + 2**k).alias("place"), F.col("dst").alias("node"))
        places = materialize(places.unionByName(further.where(F.col("place") <= max_length)), "stretch-places")
    # the edge to a place begins at the place before it
    back = places.select("head", "via", (F.col("place") + 1).alias("place"), F.col("node").alias("src"))
    began = places.join(back, ["head", "via", "place"], "left").withColumn("src", F.coalesce("src", "head"))
    return began.join(edges.withColumnRenamed("dst", "node"), ["src", "node"]).select("head", "via", "place", "src", "node", "cnt")


#: Stretches that a leap of `_regions` covers is 2 ** LEAPS; starts of a group at most, about; rounds by leaps in which groups are found.
LEAPS, GROUP, LABELS = 3, 256, 4


def _near(rows: DataFrame, max_length: int) -> DataFrame:
    return rows.where(F.col("dist") < max_length).groupBy("start", "head").agg(F.min("dist").alias("dist"))


def _on(rows: DataFrame, leap: DataFrame) -> DataFrame:
    further = leap.select(F.col("start").alias("mid"), "head", F.col("dist").alias("more"))
    return rows.withColumnRenamed("head", "mid").join(further, "mid").select("start", "head", (F.col("dist") + F.col("more")).alias("dist"))


def _leaps(whole: DataFrame, max_length: int) -> DataFrame:
    """(start, head, dist): least distances below max_length over up to 2 ** LEAPS stretches."""
    leap = materialize(_near(whole.select(F.col("head").alias("start"), F.col("to").alias("head"), F.col("edges").cast("long").alias("dist")), max_length), "leaps")
    for _ in range(LEAPS):
        leap = materialize(_near(leap.unionByName(_on(leap, leap)), max_length), "leaps")
    return leap


def _groups(leap: DataFrame, starts: DataFrame) -> DataFrame:
    """(group, start): starts whose regions overlap, mostly together.

    A label is the least hash found going on from a node; starts that go on to the same nodes come to the same label. Where many do,
    they are dealt to groups of about `GROUP`, so no task searches a whole graph.
    """
    own = lambda c: F.xxhash64(c)
    labels = leap.groupBy("start").agg(F.min(own("head")).alias("label")).select("start", F.least("label", own("start")).alias("label"))
    for _ in range(LABELS - 1):
        labels = materialize(labels, "labels")
        there = leap.join(labels.select(F.col("start").alias("head"), F.col("label").alias("there")), "head", "left")
        further = there.groupBy("start").agg(F.min(F.coalesce("there", own("head"))).alias("further"))
        labels = labels.join(further, "start").select("start", F.least("label", "further").alias("label"))
    named = materialize(starts.join(labels, "start", "left").select("start", F.coalesce("label", own("start")).alias("label")), "labels")
    split = named.join(named.groupBy("label").agg(F.ceil(F.count("*") / GROUP).alias("n")), "label")
    return split.select(F.xxhash64("label", F.pmod(F.xxhash64("start", F.lit(1)), "n")).alias("group"), "start")


def _regions(whole: DataFrame, starts: DataFrame, max_length: int) -> DataFrame:
    """(group, head, begins): the junctions less than max_length edges from any start of a group; begins: whether it is a start.

    Regions of neighbours are nearly the same, so they are held once a group. Least distances over up to 2 ** LEAPS stretches are
    joined from themselves once; groups then move by such leaps, so the rounds grow with the eighth of the stretches on a path.
    """
    leap = _leaps(whole, max_length)
    found = now = materialize(_groups(leap, starts).select(F.col("group").alias("start"), F.col("start").alias("head"), F.lit(0).cast("long").alias("dist")), "regions")
    while not now.isEmpty():
        old = found.select("start", "head", F.col("dist").alias("old"))
        further = _near(_on(now, leap), max_length).join(old, ["start", "head"], "left").where("old IS NULL OR dist < old")
        now = materialize(further.select("start", "head", "dist"), "regions-on")
        found = materialize(_near(found.unionByName(now), max_length), "regions")
    return found.select(F.col("start").alias("group"), "head", (F.col("dist") == 0).alias("begins"))


_SIDES = "start long, at long, side int, weight long, junctions array<bigint>, vias array<bigint>"


def _first_meeting(start: int, ways: dict[int, list], max_length: int) -> list[tuple]:
    """The two sides of the bubble of one start, from the stretches around it; no rows if no two paths meet.

    Paths are taken by length. As long as no two of a length meet there is one for each junction and length.
    """
    reached: dict[int, dict[int, list]] = {0: {start: [(None, start, None, 0)]}}  # by length and node: (path before, node, via, weight)

    def back(path) -> tuple[list, list]:
        junctions, vias = [], []
        while path is not None:
            junctions.append(path[1])
            vias.append(path[2])
            path = path[0]
        return junctions[::-1], vias[-2::-1]

    for length in range(max_length + 1):
        here = reached.pop(length, {})
        met = [at for at, paths in here.items() if len(paths) > 1]
        if met:
            at = min(met)
            two = sorted((back(p)[::-1] + (p[3],) for p in here[at]))[:2]
            return [(start, at, side, weight, junctions, vias) for side, (vias, junctions, weight) in enumerate(two, 1)]
        for at, (path,) in here.items():
            if at == start and length:
                continue
            been = set(back(path)[0]) - {start}
            for via, to, edges, weight in ways.get(at, ()):
                if to not in been and length + edges <= max_length:
                    reached.setdefault(length + edges, {}).setdefault(to, []).append((path, to, via, path[3] + weight))
        if not reached:
            break
    return []


def _search(max_length: int):
    """The bubbles of all starts in batches of (group, head, begins, via, to, edges, weight), a group's rows together."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            rows = [r for start in starts for r in _first_meeting(start, ways, max_length)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=["start", "at", "side", "weight", "junctions", "vias"])

        now, starts, ways = None, set(), {}
        for batch in batches:
            for group, head, begins, *way in zip(*(batch.column(c).to_pylist() for c in ("group", "head", "begins", "via", "to", "edges", "weight"))):
                if group != now:
                    if starts:
                        yield found()
                    now, starts, ways = group, set(), {}
                if begins:
                    starts.add(head)
                ways.setdefault(head, []).append(way)
        if starts:
            yield found()

    return run


def _ways(junctions, vias):
    """Array of (head, via): the pieces of a path."""
    return F.arrays_zip(F.slice(junctions, F.lit(1), F.size(vias)).alias("head"), vias.alias("via"))


def _bubble_sides(pieces: Pieces, conf: Simplification) -> DataFrame:
    """(start, at, side, weight, junctions, vias): both paths of each bubble."""
    whole = materialize(pieces.short.where(F.col("edges") <= conf.bubble_max_length).select("head", "via", "to", "edges", "weight"), "ways")
    branching = pieces.short.groupBy("head").agg(F.count("*").alias("n")).where("n >= 2").select(F.col("head").alias("start"))
    around = _regions(whole, branching, conf.bubble_max_length).join(whole, "head").select("group", "head", "begins", "via", "to", "edges", "weight")
    # two paths part at a junction, so their choices order them as their nodes do
    # a number of partitions, since few rows hold much work
    dealt = around.repartition(int(around.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group")
    return materialize(dealt.mapInArrow(_search(conf.bubble_max_length), _SIDES), "bubble-sides")


def find_bubbles(edges: DataFrame, conf: Simplification = Simplification()) -> DataFrame:
    """(start, end, paths, weights): the two paths of equal length that meet first, heavier first.

    Of the simple paths from a branching node, as many edges long each, the first two that meet in a node make its bubble:
    fewest edges, then the least such node, then the lexicographically least paths. Paths can only part and meet in
    junctions, so they grow by whole stretches, and a path is the junctions and the choices it made. Starts are searched in
    groups, which hold the stretches within bubble_max_length edges of any of them once. Only the paths of bubbles are
    written out, node by node.
    """
    return bubbles_of(Pieces.of(edges), conf)


def bubbles_of(pieces: Pieces, conf: Simplification = Simplification()) -> DataFrame:
    """As `find_bubbles`, of a graph in pieces."""
    two = _bubble_sides(pieces, conf)
    hops = two.select("start", "side", F.posexplode(_ways(F.col("junctions"), F.col("vias"))).alias("hop", "h"))
    ids = hops.select("start", "side", "hop", "h.head", "h.via").join(pieces.short.select("head", "via", "sid"), ["head", "via"])
    nodes_ = ids.join(pieces.whole.select("sid", "nodes"), "sid")
    path = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("hop", "nodes"))), lambda x: x["nodes"]))
    written = nodes_.groupBy("start", "side").agg(F.concat(F.array("start"), path).alias("path"))
    sides = written.join(two.select("start", "side", F.col("at").alias("end"), "weight"), ["start", "side"])
    # the heavier first; of equal ones the first
    best = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("light"), "side", "path", "weight")))
    return sides.groupBy("start", "end").agg(best.alias("s")).select("start", "end", F.col("s.path").alias("paths"), F.col("s.weight").alias("weights"))


def pop_bubbles(edges: DataFrame, conf: Simplification = Simplification()) -> tuple[DataFrame, DataFrame]:
    """Edges without the lighter path of each bubble, and the bubbles."""
    bubbles = find_bubbles(edges, conf)
    loser = F.col("paths")[1]
    steps = bubbles.select(F.explode(F.arrays_zip(F.slice(loser, 1, F.size(loser) - 1).alias("src"), F.slice(loser, 2, F.size(loser) - 1).alias("dst"))).alias("e")).select("e.src", "e.dst").distinct()
    return remove_edges(edges, steps), bubbles


def _tip_pieces(pieces: Pieces, conf: Simplification) -> DataFrame:
    """(been, sids) of the tips that `_tips` finds: ends of pieces in the order of the walk, of which the last one stays if `kept`, and pieces.

    A walk goes on while there is exactly one other node before it, which holds within a piece; so it moves by whole ones.
    """
    known = materialize(pieces.nodes(), "piece-ends")
    back = F.col("back_way")
    seeds = [known.where(none).where(some).select(F.lit(way).alias("back_way"), "id") for way, none, some in ((True, "out_degree = 0", "in_loose > 0"), (False, "in_degree = 0", "out_loose > 0"))]
    walk = seeds[0].unionByName(seeds[1]).select("back_way", "id", F.array("id").alias("been"), F.array().cast("array<bigint>").alias("sids"), F.lit(0).alias("edges"), F.lit(0).cast("long").alias("weight"))
    finished = None
    for _ in range(conf.tip_max_length + 1):
        more, fewer = F.when(back, F.col("out_loose")).otherwise(F.col("in_loose")), F.when(back, F.col("in_loose")).otherwise(F.col("out_loose"))
        way = F.when(fewer == 1, F.when(back, F.col("back")).otherwise(F.col("on")))
        walk = materialize(walk.join(known, "id").select("back_way", "been", "sids", "edges", "weight", more.alias("more"), fewer.alias("fewer"), way.alias("way")), "tip-walk")
        there = F.array_contains("been", F.coalesce("way.node", F.lit(-1).cast("long"))) & F.col("way").isNotNull()
        # a walk that comes back within a piece ends at an inner node, so it is no tip
        ended = walk.where(F.col("way").isNull() | (there & (F.col("way.edges") == 1))).select("been", "sids", "edges", "weight", "more", "fewer")
        finished = ended if finished is None else finished.unionByName(ended)
        further = walk.where(F.col("way").isNotNull() & ~there & (F.col("edges") + F.col("way.edges") <= conf.tip_max_length))
        if further.isEmpty():
            break
        walk = further.select("back_way", F.col("way.node").alias("id"), F.concat("been", F.array("way.node")).alias("been"), F.concat("sids", F.array("way.sid")).alias("sids"),
                              (F.col("edges") + F.col("way.edges")).alias("edges"), (F.col("weight") + F.col("way.weight")).alias("weight"))
    fit = finished.where("edges > 0").where(F.col("weight") / F.col("edges") <= conf.tip_min_depth).where("fewer = 0 OR more > 1")
    return materialize(fit.select("been", "sids", (F.col("fewer") > 0).alias("kept")), "tips")


def simplify_pieces(pieces: Pieces, conf: Simplification = Simplification()) -> tuple[Pieces, dict]:
    """Trim tips and pop bubbles until neither finds any, as `trim_tips` and `pop_bubbles` do; with counts of what went."""
    done = {"tips_removed": 0, "bubbles_removed": 0, "iterations": 0}
    for _ in range(conf.max_iterations):
        tips = _tip_pieces(pieces, conf)
        n_tips = tips.count()
        if n_tips:
            ends = tips.select(F.explode(F.when(F.col("kept"), F.slice("been", F.lit(1), F.size("been") - 1)).otherwise(F.col("been"))).alias("id")).distinct()
            pieces = pieces.without(tips.select(F.explode("sids").alias("sid")).distinct(), ends)
        n_bubbles = 0
        if n_tips or not done["iterations"] or n_popped:
            sides = _bubble_sides(pieces, conf)
            n_bubbles = sides.where("side = 1").count()
        if n_bubbles:
            # the lighter one goes; of equal ones the second
            loser = sides.groupBy("start").agg(F.max(F.struct((-F.col("weight")).alias("light"), "side", "junctions", "vias")).alias("l"))
            lost = loser.select(F.explode(_ways(F.col("l.junctions"), F.col("l.vias"))).alias("w")).select("w.head", "w.via").distinct()
            pieces = pieces.without(pieces.short.join(lost, ["head", "via"], "left_semi").select("sid"))
        n_popped = n_bubbles
        done = {"tips_removed": done["tips_removed"] + n_tips, "bubbles_removed": done["bubbles_removed"] + n_bubbles, "iterations": done["iterations"] + 1}
        if not n_tips and not n_bubbles:
            break
    return pieces, done


def simplify(edges: DataFrame, conf: Simplification = Simplification()) -> tuple[DataFrame, dict]:
    """Trim tips and pop bubbles until neither finds any; with counts of what went."""
    pieces, done = simplify_pieces(Pieces.of(edges), conf)
    return pieces.edges(), done


def trails(edges: DataFrame, prefer_high_depth: bool = True) -> DataFrame:
    """(src, dst, cnt, trail, rank): every edge in exactly one trail, as `Pieces.trails` makes them."""
    found = Pieces.of(edges).trails(prefer_high_depth)
    back = F.concat(F.array("head"), F.slice("nodes", F.lit(1), F.size("nodes") - 1))
    steps = found.select("trail", F.posexplode(F.arrays_zip(back.alias("src"), F.col("nodes").alias("dst"), F.col("cnts").alias("cnt"))).alias("rank", "e"))
    return steps.select("e.src", "e.dst", "e.cnt", "trail", F.col("rank").cast("long").alias("rank"))


def _departures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, prev, r, i): what each way out of a junction goes on from, in the order of the arrivals' times; without one, it starts trail (r, i).

    The ways out are taken in their order, by an arrival or, at the junction's own turn, by trails that start there.
    """
    for batch in batches:
        sid, prev, turn, place = [], [], [], []
        for rank, outs, ins in zip(*(batch.column(c).to_pylist() for c in ("r", "outs", "ins"))):
            events = [((x["r"], x["i"], x["s"], x["sid"]), x["sid"]) for x in ins or () if x["r"] is not None]
            events += [((rank, i, -1, -1), None) for i in range(len(outs))]
            events.sort(key=lambda e: e[0])
            events += [(None, x["sid"]) for x in ins or () if x["r"] is None]  # of no trail yet: after all others
            taken = 0
            for time, arrived in events:
                if taken < len(outs) and (arrived is not None or time[1] == taken):
                    sid.append(outs[taken]["sid"])
                    prev.append(arrived)
                    turn.append(rank)
                    place.append(taken)
                    taken += 1
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sid, prev, turn, place)], names=["sid", "prev", "r", "i"])


def greedy_trails(edges: DataFrame, prefer_high_depth: bool = True) -> DataFrame:
    """(src, dst, cnt, trail, rank): the trails that walks make one after the other, each along the heaviest edge left.

    Walks start at the nodes with more edges out than in, by falling excess, then at other junctions, then at nodes of unbranched
    circles, ties by node; from a node every edge that is left starts one, the heaviest first (or by node alone).
    So the ways out of a node are taken in a fixed order, by whoever comes next, and all that has to be found is when each way into a node
    is walked. All are assumed to be walked at some time (trail, step); arrivals at a node, sorted by these times, are given its ways
    out; the chains that this makes say when each way would then be walked; and so on until no time changes. The first
    time that is wrong is set right by each round, so what stays is what walks one by one would give. Ways are whole stretches between
    junctions, chains are followed by pointer doubling, and a junction has its edges (eight in a k-mer graph) in one row.
    """
    e = materialize(edges.select("src", "dst", "cnt"), "graph")
    places = materialize(stretches(e, max(e.count(), 1)), "stretches")
    d = materialize(degrees(e).select("id", (F.col("out_degree") - F.col("in_degree")).alias("excess")), "excess")
    ends = places.groupBy("head", "via").agg(F.max(F.struct("place", "node"))["node"].alias("to"), F.max("place").alias("edges"), F.min(F.struct("place", "cnt"))["cnt"].alias("first"))
    ways = materialize(ends.withColumn("sid", F.monotonically_increasing_id()), "ways")
    first = F.when(F.col("excess") > 0, -F.col("excess")).otherwise(0)
    turns = number_rows(d.join(ways.select(F.col("head").alias("id")).distinct(), "id").withColumn("first", first), "first", "id", name="r").select(F.col("id").alias("node"), "r")
    order = F.struct(-F.col("first"), "via", "sid") if prefer_high_depth else F.struct("via", "sid")
    outs = ways.groupBy(F.col("head").alias("node")).agg(F.array_sort(F.collect_list(order)).alias("outs"))
    outs = materialize(outs.join(turns, "node").select("node", "r", F.transform("outs", lambda x: F.struct(x["sid"].alias("sid"))).alias("outs")), "ways-out")
    times = outs.select(F.posexplode("outs").alias("i", "o"), "r").select("o.sid", F.col("r").cast("long").alias("r"), F.col("i").cast("long").alias("i"), F.lit(0).cast("long").alias("s"))
    times = materialize(times.withColumn("root", F.col("sid")), "times")
    doublings = max(1, ways.count()).bit_length() + 1
    while True:
        ins = times.drop("root").join(ways.select("sid", F.col("to").alias("node")), "sid").groupBy("node").agg(F.collect_list(F.struct("r", "i", "s", "sid")).alias("ins"))
        found = outs.join(ins, "node", "left").select("r", "outs", "ins").mapInArrow(_departures, "sid long, prev long, r long, i long")
        lone = F.col("prev").isNull()
        now = materialize(found.select(
            "sid", F.col("prev").alias("at"), F.when(lone, 0).otherwise(1).cast("long").alias("s"),
            *(F.when(lone, F.col(c)).alias(n) for c, n in (("r", "r"), ("i", "i"), ("sid", "root")))), "times")
        for _ in range(doublings):
            if now.where("at IS NOT NULL").isEmpty():
                break
            jump = now.select(F.col("sid").alias("at"), F.col("at").alias("on"), F.col("s").alias("more"), *(F.col(c).alias(f"{c}2") for c in ("r", "i", "root")))
            now = materialize(now.join(jump, "at", "left").select(
                "sid", F.col("on").alias("at"), (F.col("s") + F.coalesce("more", F.lit(0))).alias("s"), *(F.coalesce(c, f"{c}2").alias(c) for c in ("r", "i", "root"))), "times")
        # what still has no start goes round in a circle and is of no trail yet
        now = now.select("sid", "r", "i", F.when(F.col("r").isNotNull(), F.col("s")).alias("s"), "root")
        same = times.join(now.select("sid", *(F.col(c).alias(f"{c}2") for c in "ris")), "sid").where(" AND ".join(f"{c} <=> {c}2" for c in "ris"))
        settled = same.count() == times.count()
        times = now
        if settled:
            break
    along = Window.partitionBy("root").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ways.join(times, "sid").withColumn("before", F.coalesce(F.sum("edges").over(along), F.lit(0))).select("head", "via", "root", "before")
    walked = places.join(ranked, ["head", "via"]).select("src", F.col("node").alias("dst"), "cnt", F.col("root").alias("trail"), (F.col("before") + F.col("place") - 1).cast("long").alias("rank"))
    walked = materialize(walked, "trails")
    circles = materialize(e.join(walked, ["src", "dst"], "left_anti").select("src", "dst", "cnt"), "circles")
    if circles.isEmpty():
        return walked
    return walked.unionByName(trails(circles, prefer_high_depth).withColumn("trail", -F.col("trail") - 1).withColumn("rank", F.col("rank").cast("long")))


def path_sequence(path, k: int):
    """Text of an array of nodes: the first, then the last base of each other; empty for an empty path."""
    ends = F.transform(F.slice(path, F.lit(2), F.size(path)), lambda n: F.substr(F.lit(dna.BASES), (n.bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)))
    return F.when(F.size(path) > 0, F.concat(dna.decode(F.try_element_at(path, F.lit(1)), k - 1), F.array_join(ends, ""))).otherwise("")


def contigs(edges: DataFrame, k: int, min_length: int = 200, prefer_high_depth: bool = True, greedy: bool = False) -> DataFrame:
    """(name, sequence, length, num_kmers, avg_depth, path_nodes, is_circular) of trails of min_length bases or more, longest first.

    Trails are local pairings of edges, or with `greedy` what walks one after the other would find.
    """
    if greedy:
        steps = F.sort_array(F.collect_list(F.struct("rank", "src", "dst", "cnt")))
        whole = greedy_trails(edges, prefer_high_depth).groupBy("trail").agg(steps.alias("steps"))
        whole = whole.select("trail", F.col("steps")[0]["src"].alias("head"), F.col("steps.dst").alias("nodes"), F.col("steps.cnt").alias("cnts"))
        return _contigs_of(whole, k, min_length)
    return _contigs_of(Pieces.of(edges).trails(prefer_high_depth), k, min_length)


def _contigs_of(trails: DataFrame, k: int, min_length: int, path_nodes: bool = True) -> DataFrame:
    made = trails.select(
        "trail", F.size("nodes").alias("num_kmers"), F.aggregate("cnts", F.lit(0.0), lambda a, c: a + c).alias("total"), F.concat(F.array("head"), F.col("nodes")).alias("path_nodes"),
    ).where(F.size("path_nodes") + (k - 2) >= min_length)
    circular = F.element_at("path_nodes", 1) == F.element_at("path_nodes", -1)
    made = made.withColumn("sequence", path_sequence(F.col("path_nodes"), k)).withColumn("length", F.length("sequence")).withColumn("is_circular", circular)
    # the nodes are eight times the sequence, so they are not exchanged unless they are asked for; numbering reads its rows twice
    made = made if path_nodes else materialize(made.drop("path_nodes"), "contig-rows")
    named = number_rows(made, F.desc("length"), "sequence", "trail").withColumn("name", F.format_string("contig_%04d", "row_number"))
    return named.select("name", "sequence", "length", "num_kmers", (F.col("total") / F.col("num_kmers")).alias("avg_depth"), *(["path_nodes"] if path_nodes else []), "is_circular")


def assemble(reads: DataFrame, k: int = 31, min_count: int = 2, min_length: int = 200, conf: Simplification = Simplification(), path_nodes: bool = True) -> DataFrame:
    """Contigs of reads: count k-mers, drop rare ones, simplify the graph, follow its trails; without `path_nodes` if they are not needed."""
    pieces, _ = simplify_pieces(Pieces.of_reads(reads, k, min_count), conf)
    return _contigs_of(pieces.trails(), k, min_length, path_nodes)


@dataclass(frozen=True)
class Assembly:
    """What an `Assembler` made: contigs, one-row tables of graph and contig statistics, counts of what went."""

    contigs: DataFrame
    before: DataFrame
    after: DataFrame
    removed: dict
    stats: DataFrame


@dataclass(frozen=True)
class Assembler:
    k: int = 31
    min_kmer_count: int = 2
    min_contig_length: int = 200
    tip_max_length: int = 10
    tip_min_depth: float = 2.0
    bubble_max_length: int = 100
    simplify_iterations: int = 5
    prefer_high_depth: bool = True
    greedy: bool = True

    @classmethod
    def default(cls) -> Assembler:
        return cls()

    def assemble(self, reads: DataFrame, output_fasta: str | None = None) -> Assembly:
        """Count, filter, graph, simplify and contigs of (read_id, sequence), with statistics; contigs go to a FASTA folder if one is named."""
        conf = Simplification(self.tip_max_length, self.tip_min_depth, self.bubble_max_length, self.simplify_iterations)
        graph = materialize(build(reads, self.k, self.min_kmer_count), "graph")
        simple, removed = simplify(graph, conf)
        made = materialize(contigs(simple, self.k, self.min_contig_length, self.prefer_high_depth, self.greedy), "contigs")
        if output_fasta:
            text = records.contig_fasta(F.col("name"), F.col("sequence"), F.col("avg_depth"), F.col("is_circular"))
            write_records(made.select("name", text.alias("record")), output_fasta, order_by="name")
        return Assembly(made, stats(graph, self.k), stats(simple, self.k), removed, length_stats(made))


def length_stats(sequences: DataFrame, column: str = "sequence") -> DataFrame:
    """One row: num_contigs, total_bases, n50, n90, max_length, min_length, avg_length, gc_content.

    N-x needs lengths only, so equal lengths are counted first and the running sum goes over
    distinct lengths.
    """
    length = F.length(column)
    gc, atcg = (F.sum(F.length(F.regexp_replace(column, p, "")).cast("long")) for p in ("[^GC]", "[^ATCG]"))
    by = sequences.groupBy(length.alias("length")).agg(F.count("*").alias("n"), gc.alias("gc"), atcg.alias("atcg"))
    run = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("length").cast("long") * F.col("n")
    cum = by.withColumn("cum", F.sum(mass).over(run)).withColumn("total", F.sum(mass).over(Window.partitionBy()))
    at = lambda x: F.coalesce(F.max(F.when(F.col("cum") >= F.lit(x) * F.col("total"), F.col("length"))), F.lit(0))
    return cum.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_contigs"), F.coalesce(F.max("total"), F.lit(0)).alias("total_bases"), at(0.5).alias("n50"), at(0.9).alias("n90"),
        F.coalesce(F.max("length"), F.lit(0)).alias("max_length"), F.coalesce(F.min("length"), F.lit(0)).alias("min_length"),
        F.coalesce(F.try_divide(F.max("total"), F.sum("n")), F.lit(0.0)).cast("double").alias("avg_length"), F.coalesce(F.try_divide(F.sum("gc"), F.sum("atcg")), F.lit(0.0)).cast("double").alias("gc_content"),
    )
