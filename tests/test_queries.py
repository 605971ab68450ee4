"""Every registered query against its SQL, and properties of those that SQL can't express."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tallyloom.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else v

    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for a, b in zip(plain(got), plain(want), strict=True):
        assert a == pytest.approx(b) if all(isinstance(v, (float, type(None))) for v in a) else a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_linked_loans_invariants(spark):
    got = registry.QUERIES["link_loans"](spark, SF).toPandas()
    assert not got.duplicated(["lender", "period", "loan_id"]).any() and (got.loan_id.str.split("-").str[0] == got.lender.astype(str)).all()
    assert (got.groupby("loan_id").match_method.apply(lambda m: (m == "new").sum()) == 1).all()


def test_dropped_clusters_follow_the_rules(spark):
    got = registry.QUERIES["cluster_subset_sum"](spark, SF).toPandas()
    for _, g in got[got.groupby("l_orderkey").dropped.transform("any")].groupby("l_orderkey"):
        total, kept = g.total.iloc[0], g.amount[~g.dropped].sum()
        assert g.amount.sum() > 1.02 * total
        assert 0.8 * total <= kept <= 1.15 * total or (g.amount[g.dropped] >= 0.5 * total).all()


@pytest.mark.parametrize("gone", [["llm"], ["llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_imports_without_the_optional_parts(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", *gone, "__pycache__", "spark-warehouse"))
    ops = "llm" not in gone and (ROOT / "tallyloom/llm").exists()
    code = f"import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'bdc_quarter' in q and set(o) <= set(q) and 'pipeline' not in q and any(n.startswith('op1_') for n in q) == {ops}"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": ""})
