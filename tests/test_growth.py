"""What must not grow with the tables: lists in one row, repeated scans, facts that are sent to every executor."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from lodespark.operators import claims as C
from lodespark.operators import sizes
from tests.test_operators import FACTS, RULES

PARTS = [(1, "a b", "Brand#1", "ECONOMY", 3), (2, "c d", "Brand#2", "SMALL", 5), (2, "c d", "Brand#2", "SMALL", 5), (3, "e f", "Brand#1", "LARGE", 7), (4, "g h", "Brand#3", "STANDARD", 9), (5, "i j", "Brand#3", "MEDIUM", 0)]
ORDERED = [(1, 1), (1, 1), (1, 10), (1, 2), (2, 11), (2, 3), (2, 12), (3, 1), (4, 1), (9, 1), (1, None)]


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    """Parts, one of them twice, and their line items."""
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(ORDERED, "l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def _sql(folder: str, name: str) -> Counter:
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    for t, columns in (("supplier", "s_suppkey, 0.0 as s_acctbal"), ("documents", "s_suppkey as doc_id, '' as source, '' as text"), ("events", "s_suppkey as event_id, '' as event_type, 0 as user_id")):
        con.execute(f"create view {t} as select {columns} from (values (1)) v(s_suppkey)")
    return Counter(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def _rows(spark, folder: str, name: str) -> Counter:
    return Counter(tuple(r) for r in __spark_entry__.queries()[name](spark, folder).collect())


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _claims(spark):
    lists = [
        {"scopeModules": ["core"], "forbiddenReferences": ["bad.", "p."], "forbiddenImports": ["bad.x"]}, {"forbiddenReferences": ["p.core"]}, {"forbiddenImports": ["bad."], "severity": "warning"}, {"forbiddenReferences": ["none."]}, {"mustBeAcyclic": True},
        {"allowedDependencies": []}, {"verifiedBy": ["ATest", "NoTest"]}, {"requiredEvidenceTypes": ["ci", "bench"], "requiredDocs": ["notes/*"]}, {}, {"status": "accepted"},
    ]
    schema = "id string, ord long, severity string, status string, mustBeAcyclic boolean, " + ", ".join(f"{k} array<string>" for k in RULES)
    return spark.createDataFrame([(f"c{i}", i, c.get("severity"), c.get("status"), c.get("mustBeAcyclic", False), *[c.get(k) for k in RULES]) for i, c in enumerate(lists)], schema)


def test_claim_failures_are_counted_without_lists(spark):
    facts = {k: spark.createDataFrame(*v) for k, v in FACTS.items()}
    assert C.error_failures(C.judged(_claims(spark), **facts)).first()[0] == C.error_failures(C.verified(_claims(spark), **facts)).first()[0] == 6
    assert "collect_list" not in _plan(__spark_entry__.queries()["claim_failures"](spark, __spark_entry__.SMOKE))


def test_claim_status_counts_what_the_lists_hold(spark):
    facts = {k: spark.createDataFrame(*v) for k, v in FACTS.items()}
    lists = {r.id: (r.status, len(r.violations or [])) for r in C.verified(_claims(spark), **facts).collect()}
    assert {r.id: (r.status, r.violations) for r in C.judged(_claims(spark), **facts).collect()} == lists and lists["c0"] == ("failed", 4)
    assert "collect_list" not in _plan(__spark_entry__.queries()["claim_status"](spark, __spark_entry__.SMOKE))


def test_forbidden_references_read_the_line_items_once(spark, small_tables):
    df = __spark_entry__.queries()["forbidden_references"](spark, small_tables)
    assert Counter(tuple(r) for r in df.collect()) == _sql(small_tables, "forbidden_references")
    plan = _plan(df)
    assert len(re.findall(r"Relation \[l_partkey", plan)) == 1 and not re.search(r"Join Inner, \(id#\d+ = id#\d+\)", plan)


def test_inverse_references_shuffle_in_more_parts_as_the_input_grows(spark, small_tables, monkeypatch):
    monkeypatch.setattr(sizes, "PARTITION", 100)
    df = __spark_entry__.queries()["inverse_references"](spark, small_tables)
    parts = [int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", _plan(df))]
    assert parts and min(parts) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert Counter(tuple(r) for r in df.collect()) == _sql(small_tables, "inverse_references")


def _broadcast_facts(df) -> list[str]:
    """Scans of tables below a broadcast, but for those that are aggregated in between."""
    found, above = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        while above and above[-1][0] >= depth:
            above.pop()
        if "BroadcastExchange" in line or "Aggregate(" in line:
            above.append((depth, "BroadcastExchange" in line))
        elif "FileScan" in line and above and above[-1][1]:
            found.append(line)
    return found


def test_working_sets_broadcast_no_facts(spark):
    assert _broadcast_facts(__spark_entry__.queries()["working_sets"](spark, __spark_entry__.SMOKE)) == []


def test_context_footprint_broadcasts_no_facts(spark):
    assert _broadcast_facts(__spark_entry__.queries()["context_footprint"](spark, __spark_entry__.SMOKE)) == []
