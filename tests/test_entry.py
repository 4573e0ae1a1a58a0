from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from auditweave.operators.custom_rules import STARTERS
from auditweave.plans.catalogue import GEO_RULES, RULES
from auditweave.plans.queries import ORACLE_SQL, QUERIES

#: Some payloads and bursts come in the larger table only.
DATA = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
needs_data = pytest.mark.skipif(not all(map(os.path.isdir, DATA)), reason="no test data here")


def plain(frame: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return ""
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted(tuple(cell(x) for x in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    out = {}
    for folder in DATA:
        out[folder] = duckdb.connect()
        for name in ("events", "nation"):
            out[folder].execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return out


#: Queries that meet rare payloads, or bursts and rules that the smaller table lacks.
LARGER = [name for name in sorted(ORACLE_SQL) if name.startswith(("ingest_", "export_json", "rule_", "custom_", "alert_texts", "alerts_of_everything"))]


@needs_data
@pytest.mark.parametrize(("name", "folder"), [(name, DATA[0]) for name in sorted(ORACLE_SQL)] + [(name, DATA[1]) for name in LARGER])
def test_query_agrees_with_sql(spark, duck, name, folder):
    assert plain(QUERIES[name](spark, folder).toPandas()) == plain(duck[folder].execute(ORACLE_SQL[name]).df())


@needs_data
def test_every_rule_fires(spark, duck):
    """In the trail of the larger table, so that the comparisons show something of each."""
    con, fired = duck[DATA[1]], set()
    for name in ("rule_events", "rule_bursts", "rule_geo_events", "custom_rule_events"):
        fired |= {row[0] for row in con.execute(f"SELECT DISTINCT rule_id FROM ({ORACLE_SQL[name]})").fetchall()}
    assert fired == {r.rule_id for r in RULES + GEO_RULES} | {r["id"] for r in STARTERS}


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLE_SQL)
