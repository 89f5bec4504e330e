"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
from loomspark.plans import catalog

duckdb = pytest.importorskip("duckdb")
CHECKED = sorted(n for n in catalog.QUERIES if n in catalog.ORACLES)
UNCHECKED = sorted(n for n in catalog.QUERIES if n not in catalog.ORACLES)


def canon(v):
    if v is None or isinstance(v, (bool, np.bool_)):
        return None if v is None else bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return None if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return str(v)


@pytest.fixture(scope="module")
def con(data_dir):
    c = duckdb.connect()
    for f in os.listdir(data_dir):
        name = f.removesuffix(".parquet")
        c.execute(f"create view {name} as select * from '{data_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, con, data_dir, name):
    df = catalog.QUERIES[name](spark, data_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(canon(v) for v in r) for r in df.select(*columns).collect())
    result = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == Counter(tuple(canon(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", UNCHECKED)
def test_runs(spark, data_dir, name):
    """Queries without SQL give rows; what they compute is tested on small fixtures elsewhere."""
    assert catalog.QUERIES[name](spark, data_dir).count() > 0


def test_balanced_batches(spark, data_dir):
    """Every customer has one part; the ranks of a batch differ by less than its largest row; places are an order of the batch."""
    sizes = {r.c_custkey: abs(int(r.c_acctbal)) if r.c_acctbal >= 0 else int(-r.c_acctbal) for r in spark.read.parquet(f"{data_dir}/customer.parquet").collect()}
    rows = catalog.QUERIES["srt18_rank_balance"](spark, data_dir).collect()
    assert sorted(r.k for r in rows) == sorted(sizes)
    batches = {}
    for r in rows:
        batches.setdefault(r.g, []).append(r)
    for batch in batches.values():
        assert sorted(r.place for r in batch) == list(range(len(batch)))
        assert [r["rank"] for r in sorted(batch, key=lambda r: r.place)] == sorted(r["rank"] for r in batch)
        loads = Counter()
        for r in batch:
            loads[r["rank"]] += sizes[r.k]
        assert max(loads.values()) - min(loads.values()) <= max(sizes[r.k] for r in batch)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_equals_fold(spark, data_dir):
    fold = {r["run"]: r for r in catalog.QUERIES["win6_plateau"](spark, data_dir).collect()}
    stream = {}
    for r in catalog.QUERIES["str1_plateau_stream"](spark, data_dir).collect():
        if r["run"] not in stream or r["step"] > stream[r["run"]]["step"]:
            stream[r["run"]] = r
    assert stream == fold
