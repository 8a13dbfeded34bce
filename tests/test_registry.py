"""Every registered query with SQL gives the SQL's rows at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as registry
from tracemill.plans import catalog, oracle

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert registry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_rows(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    con.sql("CREATE TABLE b AS " + oracle.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(con.table("b").columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    mine = sorted((tuple(r) for r in got.select(columns).collect()), key=key)
    theirs = sorted(con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + " FROM b").fetchall(), key=key)
    assert mine == theirs


def test_findings_of_equal_impact_are_shown_by_hours(spark, tmp_path):
    """Six loops of all cases whose impact is 100; those with more repeats have fewer hours."""
    at = str(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"""COPY (
      SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-02' + (i * 60 + k) * INTERVAL 1 MINUTE AS ts, u AS user_id, 'a' || i AS event_type, 1e6 * (i + 1) AS value, '' AS props
      FROM range(40) us(u), range(6) kinds(i), range(8) repeats(k) WHERE k < 8 - i
    ) TO '{at}' (FORMAT parquet)""")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{at}'")
    wanted = con.sql(oracle.ORACLE_SQL["findings_shown"])
    rows = [dict(zip(wanted.columns, r)) for r in wanted.fetchall()]
    assert {r["impact_score"] for r in rows} == {100.0} and len(rows) == 5
    assert [r.asDict() for r in catalog.QUERIES["findings_shown"](spark, str(tmp_path)).collect()] == rows


def test_upsert_measures_once_for_both_thresholds(spark, monkeypatch):
    from tracemill.operators import findings

    made = []
    for name in ("transition_base", "loop_base", "variant_base", "last_early", "activity_base", "quartiles"):
        f = getattr(findings, name)
        monkeypatch.setattr(findings, name, lambda *a, f=f, name=name: made.append(name) or f(*a))
    log = catalog._fixed(spark, SF)
    first = catalog._findings(log).measured()
    other = findings.Thresholds(min_cases=2, wait_baseline_multiple=0.5, rework_case_share=0.0, handoff_threshold=0.0, rare_variant_share=1.0, manual_repetition_share=0.0)
    shared = {str(r) for r in first.under(other).all().collect()}
    assert sorted(made) == sorted(set(made)) and len(made) == 6
    assert shared == {str(r) for r in catalog._findings(log, other).all().collect()} and shared != {str(r) for r in first.all().collect()}
    made.clear()
    catalog.QUERIES["findings_upsert"](spark, SF)
    assert sorted(made) == sorted(set(made)) and len(made) == 6
