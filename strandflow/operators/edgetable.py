"""A graph's edges kept on disk by node, with a log of changes.

The edges are written twice, in buckets of their source and of their target; a log of additions and removals in the same
buckets (by target only once a version of it is read by target). What a change says of an edge is one row of the log (`gone`: what the base has of it does not count, `added`: the weight
added since), so the log is merged by a join of buckets with buckets. Reading, degrees, neighbours and joins with nodes
exchange no edges; a change exchanges the change and the log. `compact` writes base and log as a new base.

Tables are Parquet tables of the session's catalog in its warehouse (on a cluster a folder that all executors share). Every change
writes a new version of the log, and frames made before go on reading the old one; `drop_old` removes what is superseded.
Rows with a null end are left out; adding an edge again adds to its weight; removing what is not there changes nothing; an edge whose
weight falls to 0 or less is not there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDES = ("src", "dst")
_LOG = "src bigint, dst bigint, gone boolean, added bigint"


class EdgeTable:
    def __init__(self, spark: SparkSession, name: str, buckets: int):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.base, self.log = 0, 0
        self._old: list[str] = []
        # lets Spark join tables on (src, dst) that lie in buckets of one of them
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    @classmethod
    def create(cls, edges: DataFrame, buckets: int | None = None, name: str | None = None) -> EdgeTable:
        """Table of (src, dst, cnt), whose rows of one edge are added up; as many buckets as shuffles have partitions if not told."""
        spark = edges.sparkSession
        table = cls(spark, name or f"edges_{uuid.uuid4().hex}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        whole = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.sum("cnt").cast("long").alias("cnt")).where("cnt > 0")
        table._save(whole, "base", 0)
        table._save(spark.createDataFrame([], _LOG), "log", 0)
        return table

    def _named(self, kind: str, version: int, side: str) -> str:
        return f"{self.name}_{kind}{version}_{side}"

    def _save(self, rows: DataFrame, kind: str, version: int) -> None:
        """Both copies of a base; of a log the one by source, as `_read` adds the other when it is first asked for."""
        for side in SIDES[: 1 if kind == "log" else 2]:
            self._write(rows, kind, version, side)

    def _write(self, rows: DataFrame | None, kind: str, version: int, side: str) -> None:
        if side == "dst":  # from the first copy, so that both hold the same
            rows = self.spark.table(self._named(kind, version, "src"))
        dealt = rows.repartition(self.buckets, side)
        dealt.write.bucketBy(self.buckets, side).sortBy("src", "dst").format("parquet").saveAsTable(self._named(kind, version, side))

    def _read(self, kind: str, side: str) -> DataFrame:
        version = self.base if kind == "base" else self.log
        if not self.spark.catalog.tableExists(self._named(kind, version, side)):
            self._write(None, kind, version, side)
        return self.spark.table(self._named(kind, version, side))

    def _change(self, change: DataFrame) -> None:
        """A new version of the log; `change` has a row for an edge."""
        old = self._read("log", "src").withColumnsRenamed({"gone": "g", "added": "a"})
        both = old.join(change, ["src", "dst"], "full").select(
            "src", "dst", F.coalesce(F.col("gone"), F.lit(False)).alias("now"), F.coalesce("g", F.lit(False)).alias("g"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("added", F.lit(0)).alias("added"))
        merged = both.select("src", "dst", (F.col("now") | F.col("g")).alias("gone"), F.when(F.col("now"), F.col("added")).otherwise(F.col("a") + F.col("added")).cast("long").alias("added"))
        self._save(merged, "log", self.log + 1)
        self._old += [self._named("log", self.log, s) for s in SIDES]
        self.log += 1

    def add(self, edges: DataFrame) -> None:
        """Add (src, dst, cnt): new edges, and weight of known ones."""
        added = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.sum("cnt").cast("long").alias("added"))
        self._change(added.withColumn("gone", F.lit(False)))

    def remove(self, pairs: DataFrame) -> None:
        """Remove the edges named by (src, dst)."""
        self._change(pairs.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct().withColumn("gone", F.lit(True)).withColumn("added", F.lit(0).cast("long")))

    def remove_nodes(self, gone: DataFrame) -> None:
        """Remove every edge that touches a node of `gone` (id)."""
        ids = gone.select("id").distinct()
        touched = [self.join_nodes(side, ids, "left_semi").select("src", "dst") for side in SIDES]
        self.remove(touched[0].unionByName(touched[1]))

    def parts(self, side: str) -> list[DataFrame]:
        """The edges (src, dst, cnt) in two frames, those of the base and those of the log alone, both in buckets of `side`."""
        base, log = self._read("base", side), self._read("log", side)
        cnt = F.when(F.coalesce("gone", F.lit(False)), 0).otherwise(F.col("cnt")) + F.coalesce("added", F.lit(0))
        known = base.join(log, ["src", "dst"], "left").select("src", "dst", cnt.cast("long").alias("cnt")).where("cnt > 0")
        new = log.join(base, ["src", "dst"], "left_anti").where("added > 0").select("src", "dst", F.col("added").alias("cnt"))
        return [known, new]

    def each(self, side: str, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """`use` of both parts, put together; what it does by `side` exchanges no edges."""
        known, new = self.parts(side)
        return use(known).unionByName(use(new))

    def edges(self, side: str = "src") -> DataFrame:
        return self.each(side, lambda part: part)

    def join_nodes(self, side: str, nodes: DataFrame, how: str = "inner") -> DataFrame:
        """The edges with what `nodes` (id, ...) has of their `side`; only nodes are exchanged."""
        keyed = nodes.withColumnRenamed("id", side)
        return self.each(side, lambda part: part.join(keyed, side, how))

    def per_node(self, side: str) -> DataFrame:
        """(id, n, weight, least): edges of each node as `side`, their weight and the least node at their other end."""
        other = SIDES[side == "src"]
        known, new = (p.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n"), F.sum("cnt").alias("weight"), F.min(other).alias("least")) for p in self.parts(side))
        both = known.join(new.withColumnsRenamed({c: f"{c}2" for c in ("n", "weight", "least")}), "id", "full")
        total = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}2", F.lit(0))).cast("long").alias(c)
        return both.select("id", total("n"), total("weight"), F.least("least", "least2").alias("least"))

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree); a row for each node is all that is exchanged."""
        out, into = (self.per_node(side).select("id", F.col("n").alias(name)) for side, name in zip(SIDES, ("out_degree", "in_degree")))
        return out.join(into, "id", "full").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))

    def compact(self) -> None:
        """Base and log become a new base, the log is empty."""
        self._save(self.edges("src"), "base", self.base + 1)
        self._save(self.spark.createDataFrame([], _LOG), "log", self.log + 1)
        self._old += [self._named(kind, v, s) for kind, v in (("base", self.base), ("log", self.log)) for s in SIDES]
        self.base, self.log = self.base + 1, self.log + 1

    def drop_old(self) -> None:
        """Drop superseded versions; frames that still read them fail."""
        while self._old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._old.pop()}")

    def drop(self) -> None:
        self._old += [self._named(kind, v, s) for kind, v in (("base", self.base), ("log", self.log)) for s in SIDES]
        self.drop_old()
