"""Registered queries against their SQL on the smallest tables, and the stream."""

import json
import math

import duckdb
import pytest

from tracewright.plans import catalog
from tracewright.streaming import audit

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    found = db.execute(catalog.oracle_sql()[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_stream(spark, tmp_path):
    from test_traces import CRM, trace

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("\n".join([json.dumps(trace("a", CRM)), json.dumps(trace("a", CRM)), json.dumps(trace("b", CRM[:3])), "{broken"]))
    verdicts = audit.error_verdicts(audit.trace_stream(spark, str(tmp_path / "in")))
    audit.write_results(verdicts, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert {(r.trace_id, r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "false_success"), ("b", "verified")}
