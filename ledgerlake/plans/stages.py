"""Stages of the domain runs: pin the source, transform, guard, publish, record rejects.

A stage reads its source once and writes accepted and rejected rows in one job, as a new
version. Counts come from the final tasks of that job, so no pass is spent on counting, and
the guards read the written version before it is committed.
"""

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import schemas
from ledgerlake.operators import bookings, dq, envelope, expect, gold, payments, suite
from ledgerlake.operators.bronze import copy_table
from ledgerlake.operators.expect import CheckFailed
from ledgerlake.sources import buckets, versions
from ledgerlake.streaming.ingest import read_bronze


@dataclass(frozen=True)
class Layout:
    """Table locations below one root."""

    root: str

    @property
    def bronze_events(self) -> str:
        return f"{self.root}/bronze/booking_events"

    @property
    def bronze_shops(self) -> str:
        return f"{self.root}/bronze/shops"

    def silver(self, name: str) -> str:
        return f"{self.root}/silver/{name}"

    def gold(self, name: str) -> str:
        return f"{self.root}/gold/{name}"


@dataclass(frozen=True)
class StageReport:
    stage: str
    source_version: int
    input_rows: int
    rejected_rows: int
    duplicate_rows: int
    stored_rows: int
    orphan_rows: int
    violations: int = 0


REPORT = (
    "stage string, source_version bigint, input_rows bigint, rejected_rows bigint, "
    "duplicate_rows bigint, stored_rows bigint, orphan_rows bigint, violations bigint"
)


@dataclass(frozen=True)
class Run:
    """What every stage of one run shares."""

    spark: SparkSession
    layout: Layout
    as_of: date | None = None
    detected_at: datetime | None = None

    def seen(self) -> Column | None:
        return None if self.detected_at is None else F.lit(self.detected_at)

    def source(self, table: str) -> tuple[int, DataFrame]:
        pinned = versions.pin(self.spark, table)
        if pinned is None:
            raise CheckFailed(f"{table} has no committed version")
        return pinned.id, pinned.read(self.spark)

    def bronze(self) -> tuple[int, DataFrame]:
        """Bronze as of its last committed micro-batch; the file list is fixed on read."""
        table = self.layout.bronze_events
        while True:
            before = versions.last_batch(self.spark, table)
            if before is None:
                raise CheckFailed(f"{table} has no committed batch")
            rows = read_bronze(self.spark, table)
            if versions.last_batch(self.spark, table) == before:
                return before, rows

    def record_rejects(self, rejects: DataFrame, stage: str, version: int) -> None:
        rows = dq.dq_rows(rejects, stage, self.seen(), version)
        merge_rejects(rows, self.layout.silver("event_dq"))


def merge_rejects(rows: DataFrame, table: str) -> None:
    """Upsert rejects into a DQ table; only the buckets of their keys are rewritten."""
    buckets.merge(dq.latest_per_key(rows), table, "dq_key", preserve=["first_detected_at"])


def events_clean(run: Run) -> StageReport:
    """Bronze to clean events and rejects: one scan, one parse, one shuffle, one write."""
    version, source = run.bronze()
    audit = Observation()
    bad, deliveries = F.col(envelope.REJECTED), F.col(envelope.DELIVERIES)
    rows = (
        envelope.settle(envelope.parse(source), sparse=True)
        .observe(
            audit,
            F.sum(F.when(~bad, deliveries).otherwise(0)).alias("valid"),
            F.sum(F.when(bad, deliveries).otherwise(0)).alias("rejected"),
            F.count_if(~bad).alias("stored"),
            F.count_if(envelope.CONFLICT).alias("conflicts"),
        )
        .drop(envelope.DELIVERIES, envelope.CONFLICT)
    )

    def settled() -> None:
        if not audit.get["valid"] and not audit.get["rejected"]:
            raise CheckFailed("Bronze is empty")
        if audit.get["stored"] == 0:
            raise CheckFailed("no valid event in Bronze")
        if audit.get["conflicts"]:
            raise CheckFailed(f"{audit.get['conflicts']} event ids carry different payloads")

    new = versions.publish_split(rows, run.layout.silver("events_clean"), settled)
    valid, rejected, stored = (audit.get[n] for n in ("valid", "rejected", "stored"))
    if rejected:
        run.record_rejects(new.rejects(run.spark), schemas.EVENTS_STAGE, version)
    return StageReport(
        "events_clean", version, valid + rejected, rejected, valid - stored, stored, 0
    )


def _typed_stage(run, validate, columns, stage, checks=None, keep_rejects=True) -> StageReport:
    """Clean events to typed events and rejects: a narrow map and one write."""
    version, source = run.source(run.layout.silver("events_clean"))
    bad, seen = F.col("validation_error").isNotNull(), Observation()
    rows = (
        validate(source)
        .select(*columns, "validation_error", bad.alias(versions.REJECTED))
        .observe(
            seen, F.count("*").alias("n"), F.count_if(versions.REJECTED).alias("rejected")
        )
    )

    def settled() -> None:
        if seen.get["n"] == 0:
            raise CheckFailed(f"no candidate event for {stage}")
        if seen.get["n"] == seen.get["rejected"]:
            raise CheckFailed(f"no valid event for {stage}")

    new = versions.publish_split(rows, run.layout.silver(stage), settled, checks)
    n, rejected = seen.get["n"], seen.get["rejected"]
    if rejected and keep_rejects:
        run.record_rejects(new.rejects(run.spark), stage, version)
    return StageReport(stage, version, n, rejected, 0, n - rejected, 0)


def _movement_checks(written: DataFrame) -> None:
    suite.require(
        written,
        [
            suite.UniqueTest("payment_transaction_id repeats", ("payment_transaction_id",)),
            suite.AgreementTest("a payment has several request amounts", ("payment_id",), "request_amount_krw"),
        ],
    )


def booking_events_clean(run: Run) -> StageReport:
    return _typed_stage(
        run, bookings.candidates, schemas.BOOKING_EVENTS_CLEAN, schemas.BOOKINGS_STAGE
    )


def payment_events_clean(run: Run) -> StageReport:
    return _typed_stage(
        run,
        payments.candidates,
        schemas.PAYMENT_EVENTS_CLEAN,
        schemas.PAYMENTS_STAGE,
        _movement_checks,
    )


def payment_transactions_clean(run: Run) -> StageReport:
    """Superseded transaction table; its rejects are counted but not recorded."""

    def validate(events: DataFrame) -> DataFrame:
        return payments.transaction_candidates(events).withColumnRenamed(
            "event_time", "occurred_at"
        )

    return _typed_stage(
        run,
        validate,
        schemas.PAYMENT_TRANSACTIONS_CLEAN,
        "payment_transactions_clean",
        _movement_checks,
        keep_rejects=False,
    )


def _current_stage(run, source_name, build, key, name) -> StageReport:
    version, source = run.source(run.layout.silver(source_name))
    seen = source.count()
    if seen == 0:
        raise CheckFailed(f"{source_name} is empty")
    counts = Observation()
    rows = build(source).observe(
        counts, F.count("*").alias("stored"), F.count_if("is_orphan").alias("orphans")
    )

    def every_key_once(_: DataFrame) -> None:
        # the aggregate makes a key unique, so equal counts mean that every key is there once
        keys = source.select(key).distinct().count()
        if keys != counts.get["stored"]:
            raise CheckFailed(f"{name} does not hold every {key} once")

    versions.publish(rows, run.layout.silver(name), guard=every_key_once)
    stored, orphans = counts.get["stored"], counts.get["orphans"]
    return StageReport(name, version, seen, 0, 0, stored, orphans)


def bookings_current(run: Run) -> StageReport:
    return _current_stage(
        run, "booking_events_clean", bookings.current, "booking_id", "bookings_current"
    )


def payments_current(run: Run) -> StageReport:
    return _current_stage(
        run, "payment_events_clean", payments.current, "payment_id", "payments_current"
    )


def bronze_shops(run: Run, shops: DataFrame) -> StageReport:
    """Full copy of the operational shops; shops removed at the source disappear."""
    new = versions.publish(copy_table(shops, run.seen()), run.layout.bronze_shops)
    stored = new.read(run.spark).count()
    return StageReport("bronze_shops", new.id, stored, 0, 0, stored, 0)


def dim_shops(run: Run) -> StageReport:
    """The shop dimension; its data tests are counted in the report and refuse nothing."""
    version, source = run.source(run.layout.bronze_shops)
    written = versions.publish(gold.dim_shops(source), run.layout.silver("dim_shops")).read(run.spark)
    violations = sum(suite.counts(written, shop_tests()).values())
    stored = written.count()
    return StageReport("dim_shops", version, stored, 0, 0, stored, 0, violations)


def shop_daily_booking_metrics(run: Run) -> StageReport:
    version, events = run.source(run.layout.silver("booking_events_clean"))
    _, shops = run.source(run.layout.silver("dim_shops"))
    table = run.layout.gold("shop_daily_booking_metrics")
    new = versions.publish(
        gold.shop_daily_metrics(events, shops, run.as_of),
        table,
        guard=lambda written: expect.require_none(
            expect.duplicates(written, "shop_id", "report_date"), "a shop day repeats"
        ),
    )
    stored = new.read(run.spark).count()
    return StageReport("shop_daily_booking_metrics", version, events.count(), 0, 0, stored, 0)


def booking_chain(run: Run) -> StageReport:
    """Booking events through one stored validated table that feeds clean rows and DQ rows."""
    version, source = run.source(run.layout.silver("events_clean"))
    seen, kept = Observation(), Observation()
    stored = versions.publish(
        bookings.candidates(source).observe(seen, F.count("*").alias("n")),
        run.layout.silver("booking_events_validated"),
    ).read(run.spark)
    clean = versions.publish(
        bookings.clean(stored).observe(kept, F.count("*").alias("n")),
        run.layout.silver("booking_events_chain_clean"),
    ).read(run.spark)
    table = run.layout.silver("booking_event_dq")
    rows = dq.dq_rows(stored, schemas.BOOKINGS_STAGE, run.seen()).drop("source_snapshot_id")
    merge_rejects(rows, table)
    violations = suite.counts(clean, booking_tests())
    recorded = buckets.current(run.spark, table, DQ_CHAIN)
    if recorded is not None:
        violations |= suite.counts(recorded, dq_tests())
    n, left = seen.get["n"], kept.get["n"]
    return StageReport("booking_chain", version, n, n - left, 0, left, 0, sum(violations.values()))


DQ_CHAIN = T.StructType([f for f in schemas.EVENT_DQ if f.name != "source_snapshot_id"])


def booking_tests() -> list[suite.Test]:
    """Data tests of the clean booking events; their violations are reported, not refused."""
    required = ("event_id", "event_type", "event_time", "booking_id", "shop_id", "status")
    return [
        suite.not_null(*required),
        suite.unique("event_id"),
        suite.accepted("event_type", schemas.BOOKING_EVENT_TYPES),
        suite.RowTest("booking_contract", expect.contract_broken()),
    ]


def dq_tests() -> list[suite.Test]:
    return [suite.not_null("dq_key", "validation_error"), suite.unique("dq_key")]


def shop_tests() -> list[suite.Test]:
    return [
        suite.not_null("shop_id", "shop_name"),
        suite.unique("shop_id"),
        suite.RowTest("shop_dates", F.col("closed_on") < F.col("opened_on")),
    ]
