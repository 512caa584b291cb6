"""A Merkle manifest of a dataset: trees built from the bottom, proofs pushed down from the top.

Each row is a leaf, the SHA-256 of its fields with their lengths. The leaves of a source, in
order, are the bottom of its tree: every `FAN` consecutive nodes become their digest, until one
node is left. The sources' own roots, in order, are the leaves of one more tree, which ends in
the root of the dataset. Each level is written as a table of runs (a run: up to `FAN` children
and their digest), so a level is one grouping of the one below, whatever its sources hold.

Proofs come down the same tables. A run of the top has an empty proof; the runs below join the
run that holds their digest and put their own siblings before the proof it inherited; the leaves
do so last. A proof is kept once for a run, so the shuffles carry a sixteenth of all proofs, and
no task sees more of a tree than runs of `FAN`.

Edge cases: null fields are written `-`; a null source sorts first and is a source of its own; null
ids sort first; rows that agree in id are ordered by their digests, equal rows in any order (their
digests are the same); a source of one row has the leaf for a root; a dataset of one source has
that source's root; a very long text is one row; an empty table gives no rows. Extra columns are
neither hashed nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.session import materialize

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_PROOF = "array<struct<before:string,after:string>>"


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values, each `-` if null, else its UTF-8 length, `:` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def ordered_leaves(leaves: DataFrame) -> DataFrame:
    """`leaves` (key, id, digest, ...) with `pos`, the place of each among those of its key by (id, digest).

    Leaves are dealt to ranges and numbered in each; a key that goes on from earlier ranges is at
    most one of a range, so what it starts from is a row for each range.
    """
    order = ["key", "id", "digest", "row"]
    spread = leaves.withColumn("row", F.monotonically_increasing_id())
    spread = materialize(spread, "merkle-leaves").repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    numbered = materialize(spread.withColumn("pos", F.row_number().over(Window.partitionBy("range", "key").orderBy(*order[1:])).cast("long") - 1), "merkle-ordered")
    held = numbered.groupBy("range", "key").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    goes_on = held.withColumn("first", before).where("first > 0").select("range", "key", "first")
    return numbered.join(F.broadcast(goes_on), ["range", "key"], "left").withColumn("pos", F.col("pos") + F.coalesce("first", F.lit(0))).drop("range", "row", "first")


def build_levels(nodes: DataFrame) -> list[DataFrame]:
    """The runs of every level over `nodes` (key, pos, digest), each written: key, node, kids, digest, lone.

    A lone run holds the only node that its key has on that level: the key's root.
    """
    levels = []
    while True:
        place = F.expr(f"pos div {FAN}").alias("node")
        kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        runs = nodes.groupBy("key", place).agg(kids.alias("kids"))
        runs = runs.select("key", "node", "kids", F.sha2(F.concat_ws("", "kids"), 256).alias("digest"), ((F.col("node") == 0) & (F.size("kids") == 1)).alias("lone"))
        levels.append(materialize(runs, "merkle-level"))
        nodes = levels[-1].where("NOT lone").select("key", F.col("node").alias("pos"), "digest")
        if nodes.isEmpty():
            return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(key, top): the root of each key."""
    out = None
    for runs in levels:
        lone = runs.where("lone").select("key", F.col("kids")[0].alias("top"))
        out = lone if out is None else out.unionByName(lone)
    return out


def _under(children: DataFrame, runs: DataFrame) -> DataFrame:
    """`children` (key, pos, ...) with their proofs: their siblings, then what their run inherited."""
    slot = F.expr(f"CAST(pos % {FAN} AS INT)")
    siblings = F.struct(
        F.concat_ws("", F.slice("kids", F.lit(1), slot)).alias("before"),
        F.concat_ws("", F.slice("kids", slot + 2, F.lit(FAN))).alias("after"))
    joined = children.withColumn("node", F.expr(f"pos div {FAN}")).join(runs.select("key", "node", "kids", "lone", "proof", "carried"), ["key", "node"])
    return joined.withColumn("proof", F.when(F.col("lone"), F.col("proof")).otherwise(F.concat(F.array(siblings), "proof"))).drop("node", "kids", "lone")


def push_proofs(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest runs with the proofs of their digests.

    `tops` (key, proof, carried) has the proof that each key's root inherits; `carried` goes down unchanged.
    """
    above = None
    for runs in reversed(levels):
        started = runs.where("lone").join(tops, "key")
        if above is not None:
            inner = runs.where("NOT lone").withColumnRenamed("node", "pos").withColumnRenamed("kids", "own")
            inner = _under(inner.select("key", "pos", "own"), above).select("key", F.col("pos").alias("node"), F.col("own").alias("kids"), F.lit(False).alias("lone"), "proof", "carried")
            started = started.select(*inner.columns).unionByName(inner)
        above = started
    return above


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest leads to by a proof."""
    return F.aggregate(proof, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["before"], s["after"]))), 256)


def manifest(leaves: DataFrame) -> DataFrame:
    """Rows of `leaves` (key string, id, digest, ...) with subroot, root and proof.

    A proof is an array from the leaf up: the siblings before and after it on each level, as
    joined digests; both are empty where a run has one node.
    """
    placed = materialize(ordered_leaves(leaves), "merkle-placed")
    levels = build_levels(placed)
    subroots = materialize(roots(levels).select(F.lit("").alias("key"), F.col("key").alias("id"), F.col("top").alias("digest")), "merkle-subroots")
    sources = ordered_leaves(subroots)
    upper = build_levels(sources)
    top = roots(upper).select("key", F.array().cast(_NO_PROOF).alias("proof"), F.col("top").alias("carried"))
    over = _under(sources, push_proofs(upper, top))
    tops = materialize(over.select(F.col("id").alias("key"), "proof", F.struct(F.col("digest").alias("subroot"), F.col("carried").alias("root")).alias("carried")), "merkle-tops")
    lowest = materialize(push_proofs(levels, tops), "merkle-proofs")
    return _under(placed, lowest).select(*leaves.columns, "carried.subroot", "carried.root", "proof")


def tampered(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Both leaves of a document, as it is and tampered with, come from one scan of the texts.
    """
    own = [F.col(c) for c in FIELDS]
    changed = F.when(tampered(), leaf_digest(*own[:-1], F.translate("text", UPPER, LOWER)))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null sorts before any text
    leaves = docs.select(source.alias("key"), F.col("doc_id").alias("id"), leaf_digest(*own).alias("digest"), changed.alias("changed"))
    out = manifest(leaves).withColumn("folded_root", fold(F.coalesce("changed", "digest"), F.col("proof")))
    return out.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


ORACLE = f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS v
             FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
b AS (SELECT *, list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS BIGINT), 1)) AS BIGINT)) AS b FROM documents),
l AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf, {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} AS changed,
             coalesce(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, d: xor(v[(xor(c, d) % 256) + 1], c // 256))) % 5 = 0, false) AS hit FROM b, tab),
leaves AS (SELECT row_number() OVER () AS r, doc_id, leaf, CASE WHEN hit THEN changed ELSE leaf END AS folded, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
low AS (SELECT 0 AS k, g, pos, n, leaf AS digest FROM leaves
        UNION ALL SELECT k + 1, g, pos // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY k, g, pos // {FAN}),
sub AS (SELECT g, digest AS subroot FROM low WHERE n = 1),
high AS (SELECT 0 AS k, CAST(0 AS BIGINT) AS g, CAST(g - 1 AS BIGINT) AS pos, count(*) OVER () AS n, subroot AS digest FROM sub
         UNION ALL SELECT k + 1, g, pos // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY k, g, pos // {FAN}),
node AS (SELECT * FROM low WHERE n > 1 UNION ALL SELECT * FROM high WHERE n > 1),
sib AS (SELECT a.k, a.g, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
        FROM node a JOIN node b ON a.k = b.k AND a.g = b.g AND a.pos // {FAN} = b.pos // {FAN} GROUP BY a.k, a.g, a.pos),
w AS (SELECT r, 0 AS k, CAST(g AS BIGINT) AS g, CAST(pos AS BIGINT) AS pos, folded AS acc, '' AS proof, false AS ended FROM leaves
      UNION ALL SELECT r, CASE WHEN s.k IS NULL THEN 0 ELSE w.k + 1 END, CASE WHEN s.k IS NULL THEN 0 ELSE w.g END, CASE WHEN s.k IS NULL THEN w.g - 1 ELSE w.pos // {FAN} END,
             CASE WHEN s.k IS NULL THEN acc ELSE sha256(before || acc || after) END, proof || coalesce(before || after, ''), s.k IS NULL AND w.g = 0
      FROM w LEFT JOIN sib s ON w.k = s.k AND w.g = s.g AND w.pos = s.pos WHERE NOT ended)
SELECT doc_id, leaf, subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = (SELECT digest FROM high WHERE n = 1) AS verified
FROM leaves JOIN sub USING (g) JOIN w USING (r) WHERE ended
"""
