"""Registered queries against their SQL twins; LEDGERLAKE_FULL=1 runs all of them."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlake.plans.catalogue import catalogue
from ledgerlake.plans.oracle import ORACLES

SF = Path(os.environ.get("LEDGERLAKE_SF_DIR", "/root/testdata/sf0.001"))
SAMPLE = (
    "events_clean",
    "settled_events",
    "booking_events_clean",
    "bookings_current",
    "payment_errors",
    "payments_current",
    "payment_transactions_legacy",
    "ledger_replay",
    "dq_merge_rerun",
    "dq_merge_incremental",
    "test_suite_report",
    "offset_gaps",
    "selected_run",
    "recovered_bronze",
    "stream_progress",
    "stream_fanout_rows",
    "appended_rows",
    "shop_daily_booking_metrics",
    "topic_bronze_diff",
    "bronze_reconciliation",
    "ids_not_in_outbox",
    "row_constraint_violations",
    "stream_resume",
    "booking_domain_run",
)
NAMES = sorted(catalogue()) if os.environ.get("LEDGERLAKE_FULL") else SAMPLE

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no driver tables here")


def canonical(rows):
    return sorted(tuple("" if v is None else str(v) for v in row) for row in rows)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    got = entry.queries()[name](spark, str(SF))
    answer = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    columns = sorted(got.columns)
    assert sorted(names) == columns
    expected = [[row[names.index(c)] for c in columns] for row in answer.fetchall()]
    assert canonical(got.select(*columns).collect()) == canonical(expected)


def test_every_query_has_a_twin():
    assert set(catalogue()) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["shop_id", "shop_name", "report_date", "created_count", "cancelled_count"]
