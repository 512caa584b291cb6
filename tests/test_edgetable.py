"""Edges in buckets with a log of changes, against a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from strandflow.operators import debruijn
from strandflow.operators.edgetable import EdgeTable

EDGES = "src long, dst long, cnt long"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(30), rng.randrange(30)): rng.randint(1, 9) for _ in range(120)}
    made = EdgeTable.create(spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()] + [(None, 1, 1), (1, None, 1)], EDGES), 4)
    yield made, edges
    made.drop()


def test_changes(spark, table):
    made, want = table
    frame = lambda pairs: spark.createDataFrame([(a, b, c) for (a, b), c in pairs], EDGES)
    check = lambda: [rows(made.edges(side)) for side in ("src", "dst")] == [sorted((a, b, c) for (a, b), c in want.items())] * 2
    assert check()
    known = sorted(want)
    more = [((50, 51), 2), ((50, 51), 3), (known[0], 4), ((51, 50), 1)]
    made.add(frame(more))
    for e, c in more:
        want[e] = want.get(e, 0) + c
    assert check()
    before = made.edges()
    gone = [known[0], known[1], (50, 51), (99, 99)]
    made.remove(frame([(e, 0) for e in gone]))
    for e in gone:
        want.pop(e, None)
    assert check() and before.count() == len(want) + 3  # made before the change
    made.add(frame([(known[1], 7), ((50, 51), 1)]))
    want |= {known[1]: 7, (50, 51): 1}
    assert check()
    made.remove_nodes(spark.createDataFrame([(50,), (3,), (777,)], "id long"))
    want = {e: c for e, c in want.items() if not {50, 3} & set(e)}
    assert check()
    made.compact()
    made.drop_old()
    assert check() and made._read("log", "src").count() == 0
    assert rows(made.degrees()) == rows(debruijn.degrees(frame(want.items())).select("id", "out_degree", "in_degree"))
    made.add(frame([((60, 61), 1), ((60, known[-1][1]), 2)]))
    want |= {(60, 61): 1, (60, known[-1][1]): 2}
    for side, other in ((0, 1), (1, 0)):
        by = {}
        for e, c in want.items():
            by.setdefault(e[side], []).append((e[other], c))
        assert rows(made.per_node(("src", "dst")[side])) == sorted((n, len(v), sum(c for _, c in v), min(v)[0]) for n, v in by.items())


def test_edges_are_not_exchanged(spark, table):
    made, _ = table
    made.add(spark.createDataFrame([(1, 2, 3), (70, 71, 1)], EDGES))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for side in ("src", "dst"):
            assert exchanges(made.edges(side)) == 0 and exchanges(made.per_node(side)) == 0
            nodes = spark.range(40).withColumn("x", F.col("id") * 2)
            joined = made.join_nodes(side, nodes)
            assert exchanges(joined) == 2  # the nodes, for each part
            plain = made.edges(side).join(nodes.withColumnRenamed("id", side), side)
            assert rows(joined) == rows(plain.select(*joined.columns))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_log_that_nobody_reads_by_target_is_written_once(spark):
    kept = EdgeTable.create(spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "src long, dst long, cnt long"), 2)
    kept.add(spark.createDataFrame([(2, 3, 4), (3, 1, 1)], "src long, dst long, cnt long"))
    copies = lambda: sum(t.name.startswith(f"{kept.name}_log1".lower()) for t in spark.catalog.listTables())
    assert copies() == 1
    assert sorted(map(tuple, kept.edges("dst").collect())) == sorted(map(tuple, kept.edges("src").collect())) == [(1, 2, 1), (2, 3, 5), (3, 1, 1)]
    assert copies() == 2
    kept.drop()
    assert copies() == 0
