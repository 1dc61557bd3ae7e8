"""Shapes that must hold at scale: shuffles, pruning, pushdown, one parse per payload."""

import re

import pytest
from fixtures import bronze, golden_events

from ledgerlake.operators import bookings, envelope, gold, payments, reconcile
from ledgerlake.plans import derived, joined
from ledgerlake.schemas import KAFKA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning|Exchange SinglePartition", plan(df)))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stored")

    def keep(df, name):
        df.write.parquet(str(root / name))
        return spark.read.parquet(str(root / name))

    raw = keep(bronze(spark, golden_events()), "bronze")
    events = keep(envelope.dedupe(envelope.parse(raw)), "events")
    return {
        "bronze": raw,
        "events": events,
        "bookings": keep(bookings.clean(bookings.candidates(events)), "bookings"),
        "payments": keep(payments.clean(payments.candidates(events)), "payments"),
    }


def test_each_payload_is_parsed_once(stored):
    settled = envelope.settle(envelope.parse(stored["bronze"]))
    assert shuffles(settled) == 1 and plan(settled).count("from_json") == 1
    deduped = envelope.dedupe(envelope.parse(stored["bronze"]))
    assert shuffles(deduped) == 1 and plan(deduped).count("from_json") == 1


def test_typed_stages_are_narrow_and_push_the_kind_filter(stored):
    for stage in (bookings, payments):
        clean = stage.clean(stage.candidates(stored["events"]))
        text = plan(clean)
        assert shuffles(clean) == 0 and text.count("from_json") == 1
        assert "PushedFilters: [In(event_type" in text


def test_current_states_take_one_shuffle_of_pruned_columns(stored):
    for df in (bookings.current(stored["bookings"]), payments.current(stored["payments"])):
        assert shuffles(df) == 1
        text = plan(df)
        assert "partial_min" in text, "hot keys must shrink before the shuffle"
        assert "payload" not in text and "kafka_headers" not in text
    assert shuffles(joined.bookings_current(stored["bookings"])) > 1


def test_ledger_check_of_events_scans_and_shuffles_once(stored):
    df = reconcile.payment_ledger_of_events(stored["payments"])
    assert shuffles(df) == 1 and plan(df).count("FileScan") == 1 and "payload" not in plan(df)


def test_ordered_scans_read_twice_and_send_nothing_to_all_tasks(stored):
    for df in (payments.ledger_replay(stored["payments"]), bookings.transition_violations(stored["bookings"])):
        df.collect()  # the sums of the finest buckets are shuffled once and used twice
        final = plan(df).split("+- == Initial Plan ==")[0]
        assert final.count("FileScan") <= 2 and "Broadcast" not in final


def test_records_are_compared_by_digest(spark, stored):
    topic = spark.createDataFrame([], KAFKA)
    df = reconcile.bronze_vs_topic(topic, stored["bronze"])
    exchanges = [line for line in plan(df).split("\n") if "Exchange" in line]
    assert len([e for e in exchanges if "hashpartitioning" in e]) == 1
    assert not any("payload" in e for e in exchanges)


def test_ledger_check_shuffles_each_table_once(stored):
    current = payments.current(stored["payments"])
    df = reconcile.payment_ledger(current, payments.transactions(stored["payments"]))
    assert shuffles(df) == 2


def test_table_diff_shuffles_once(stored):
    df = reconcile.table_diff(stored["bookings"], stored["bookings"], "a", "b")
    assert shuffles(df) == 1 and "partial_sum" in plan(df)


def test_daily_metrics_preaggregate(spark, stored):
    counts = gold.daily_counts(stored["bookings"])
    text = plan(counts)
    assert shuffles(counts) == 1 and "partial_count" in text
    assert "payload" not in text and "In(event_type" in text


def test_no_row_at_a_time_python(spark, stored):
    frames = [
        envelope.settle(envelope.parse(stored["bronze"])),
        bookings.transition_violations(stored["bookings"]),
        payments.ledger_replay(stored["payments"]),
        derived.booking_records(
            spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
        ),
    ]
    assert not any("Python" in plan(df) or "CartesianProduct" in plan(df) for df in frames)
