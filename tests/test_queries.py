"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import math
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest
from conftest import ROOT

from sparkloom.plans import queries as own

HAS_LLM = os.path.exists(f"{ROOT}/sparkloom/llm/__init__.py")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return ""
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            return str(x)
        return f"{x:.9g}"

    return sorted(tuple(value(x.item() if hasattr(x, "item") else x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = own.QUERIES[name](spark, sf).toPandas()
    assert len(got) > 0
    same(got, duck.execute(own.ORACLE_SQL[name]).df())


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(own.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns[-1] == "customer_name"


def test_entry_without_the_llm_folders():
    """The rest imports and registers its queries when the subpackage and the corpus pipeline are gone."""
    code = "import sys; sys.modules['sparkloom.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_with_a_broken_llm_folder_fails():
    code = "import sys; sys.modules['numpy'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, timeout=120).returncode or not HAS_LLM


def test_plans_push_down_and_stay_in_the_jvm(spark, sf):
    plan = own.etl_enrich(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThanOrEqual(c_acctbal,0.0)" in plan and "c_mktsegment" not in plan
    plan = own.page_latest(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "o_totalprice" not in plan
    python = [n for n in own.QUERIES if not n.startswith("stream") and n != "mail_parse" and n in ("etl_enrich", "group_threads", "set_level", "bump_version", "event_log", "parallelism")]
    for name in python:
        assert "Python" not in own.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
