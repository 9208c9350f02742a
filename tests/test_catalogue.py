"""Every registered query of the engine against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from statelattice.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(float(v[i]) if isinstance(v[i], int | float) and not isinstance(v[i], bool) else v[i] for i in order) for v in values]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    want = rows(found.columns, found.fetchall())
    assert got and len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    found = df.collect()
    assert found
    assert not any(isinstance(v, float) and math.isnan(v) for r in found for v in r)


def test_viterbi_training_ends_by_convergence(spark, monkeypatch):
    done, train = [], catalogue.training.viterbi_training
    monkeypatch.setattr(catalogue.training, "viterbi_training", lambda *a: done.append(train(*a)) or done[-1])
    assert catalogue.QUERIES["viterbi_training_fit"](spark, str(DATA)).collect()
    assert done[0].converged
