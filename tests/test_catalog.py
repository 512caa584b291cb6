"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from strandflow import catalog

SLOW = {"dbg_components", "dbg_simplify", "dbg_bubbles", "dbg_trim_tips", "contigs", "contig_stats", "contig_fasta"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 7) + 0.0)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else repr(v)


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_query_equals_sql(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rel = connection(sf_dir).sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    want = sorted([plain(r[i]) for i in at] for r in rel.fetchall())
    assert sorted([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())


def test_labels_are_of_doubles_in_query_and_sql(spark, tmp_path):
    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = (np.arange(1, 2000) / 1000).astype(np.float32)
    split = x[np.floor(x * np.float32(1000)) != np.floor(x.astype(np.float64) * 1000)]
    assert len(split)
    pq.write_table(pa.table({"vec_id": pa.array([1], pa.int64()), "embedding": pa.array([split.tolist()], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    assert [tuple(r) for r in catalog.QUERIES["labels_to_bases"](spark, str(tmp_path)).collect()] == db.execute(catalog.ORACLES["labels_to_bases"]).fetchall()
