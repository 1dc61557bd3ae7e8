"""Payment domain: typed events, current state, ledger replay, summary rules."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import fields
from ledgerlake.functions.ordering import CREATION, LATEST_STATE, leading
from ledgerlake.functions.rules import (
    Rule,
    any_of,
    first_broken,
    missing,
    negative,
    not_equal,
    not_positive,
)
from ledgerlake.functions.running import creation_buckets, running_sums
from ledgerlake.operators.envelope import accepted
from ledgerlake.schemas import (
    ENVELOPE,
    LINEAGE,
    PAYMENT_EVENT_TYPES,
    PAYMENT_EVENTS_CLEAN,
    PAYMENT_FIELDS,
    PAYMENT_TRANSACTIONS_CLEAN,
    PAYMENTS_CURRENT,
    TRANSACTION_EVENT_TYPES,
    TRANSACTION_FIELDS,
)

# --- fixed values: movement recorded by each event type --------------------------
MOVEMENT_OF = {"payment_completed": "payment", "payment_refunded": "refund"}
SUMMARY_AMOUNTS = (
    "payout_amount_krw",
    "refund_amount_krw",
    "paid_amount_krw",
    "unpaid_amount_krw",
)
# -------------------------------------------------------------------------------


def movement() -> Column:
    event_type = F.col("event_type")
    completed, refunded = MOVEMENT_OF.items()
    return F.when(event_type == completed[0], completed[1]).when(
        event_type == refunded[0], refunded[1]
    )


def candidates(events: DataFrame, strict: bool = False) -> DataFrame:
    """Payment events with typed fields and ``validation_error``.

    A NULL ``payment_status`` makes the status predicates NULL, so by default such an
    event passes when its amounts fit some state. ``strict`` rejects it.
    """
    shaped = _typed(events, PAYMENT_EVENT_TYPES, PAYMENT_FIELDS)
    rules = [Rule("invalid_payment_type", F.col("invalid_payment_type")), *contract(strict)]
    return shaped.withColumn("validation_error", first_broken(rules))


def _typed(events: DataFrame, kinds: tuple[str, ...], wanted: dict[str, str]) -> DataFrame:
    kept = events.filter(F.col("event_type").isin(*kinds))
    shaped = fields.with_json(kept, ENVELOPE, F.col("payload"), wanted, "invalid_payment_type", LINEAGE)
    return shaped.withColumn("transaction_type", movement())


def contract(strict: bool = False) -> list[Rule]:
    kind, status = F.col("event_type"), F.col("payment_status")
    request, amount = F.col("request_amount_krw"), F.col("amount_krw")
    payout, refund = F.col("payout_amount_krw"), F.col("refund_amount_krw")
    paid, unpaid = F.col("paid_amount_krw"), F.col("unpaid_amount_krw")
    again, refund_type = F.col("needs_repayment"), F.col("refund_type")

    def wrong(value):
        return not_equal("payment_status", value) if strict else status != value

    untouched = any_of(
        *(F.col(c).isNotNull() for c in ("payment_transaction_id", "transaction_type")),
        *(F.col(c).isNotNull() for c in ("amount_krw", "refund_type")),
        payout != 0,
        refund != 0,
        paid != 0,
        unpaid != request,
        wrong("unpaid"),
        again,
    )
    mismatch = ~fits_a_state()
    return [
        Rule("invalid_payment_id", not_positive("payment_id")),
        Rule("invalid_payment_request_amount", not_positive("request_amount_krw")),
        Rule("invalid_payment_summary", negative(*SUMMARY_AMOUNTS) | missing("needs_repayment")),
        Rule("inconsistent_payment_amounts", (payout != paid + refund) | (paid > request)),
        Rule("invalid_payment_requested_fields", (kind == "payment_requested") & untouched),
        Rule(
            "invalid_payment_transaction_fields",
            kind.isin(*TRANSACTION_EVENT_TYPES)
            & (not_positive("payment_transaction_id", "amount_krw") | (amount > request)),
        ),
        Rule(
            "invalid_payment_completed_fields",
            (kind == "payment_completed") & refund_type.isNotNull(),
        ),
        Rule(
            "invalid_payment_refunded_fields",
            (kind == "payment_refunded")
            & any_of(
                missing("refund_type"),
                (paid == 0) & (refund_type != "full"),
                (paid > 0) & (refund_type != "partial"),
            ),
        ),
        Rule("inconsistent_payment_status", (status.isNull() | mismatch) if strict else mismatch),
        # kept for completeness: the previous rule already rejects every such row
        Rule("invalid_repayment_status", again & (status != "unpaid")),
    ]


def fits_a_state() -> Column:
    """Whether status, amounts and the repayment flag describe one of the four states."""
    request, paid = F.col("request_amount_krw"), F.col("paid_amount_krw")
    unpaid, refund = F.col("unpaid_amount_krw"), F.col("refund_amount_krw")
    settled = (unpaid == 0) & ~F.col("needs_repayment")
    states = {
        "unpaid": (paid < request) & (unpaid == request - paid),
        "paid": (paid == request) & settled,
        "partially_refunded": (paid > 0) & (paid < request) & (refund > 0) & settled,
        "refunded": (paid == 0) & (refund > 0) & settled,
    }
    return any_of(*((F.col("payment_status") == s) & ok for s, ok in states.items()))


def clean(validated: DataFrame) -> DataFrame:
    return accepted(validated).select(*PAYMENT_EVENTS_CLEAN)


def transactions(events: DataFrame) -> DataFrame:
    """Ledger movements only: the payment events that carry a transaction."""
    return events.filter(F.col("payment_transaction_id").isNotNull())


def transaction_candidates(events: DataFrame) -> DataFrame:
    """Superseded transaction-only contract, which predates partial collections."""
    shaped = _typed(events, TRANSACTION_EVENT_TYPES, TRANSACTION_FIELDS)
    kind, status, refund_type = (
        F.col(c) for c in ("event_type", "payment_status", "refund_type")
    )
    consistent_refund = any_of(
        (status == "partially_refunded") & (refund_type == "partial"),
        (status == "refunded") & (refund_type == "full"),
    )
    rules = [
        Rule("invalid_payment_type", F.col("invalid_payment_type")),
        Rule("invalid_payment_id", not_positive("payment_id")),
        Rule("invalid_payment_transaction_id", not_positive("payment_transaction_id")),
        Rule("invalid_payment_request_amount", not_positive("request_amount_krw")),
        Rule("invalid_payment_amount", not_positive("amount_krw")),
        Rule("payment_amount_exceeds_request", F.col("amount_krw") > F.col("request_amount_krw")),
        Rule(
            "invalid_payment_completed_fields",
            (kind == "payment_completed")
            & any_of(
                missing("payment_status"),
                ~status.isin("paid", "partially_refunded"),
                refund_type.isNotNull(),
            ),
        ),
        Rule(
            "invalid_payment_refunded_fields",
            (kind == "payment_refunded")
            & (missing("payment_status", "refund_type") | ~consistent_refund),
        ),
    ]
    return shaped.withColumn("validation_error", first_broken(rules))


def transactions_legacy(validated: DataFrame) -> DataFrame:
    return (
        accepted(validated)
        .withColumnRenamed("event_time", "occurred_at")
        .select(*PAYMENT_TRANSACTIONS_CLEAN)
    )


def current(events: DataFrame) -> DataFrame:
    """One row per payment: the summary after its latest event and its first request."""
    state = [
        "booking_id", "shop_id", "request_amount_krw", *SUMMARY_AMOUNTS,
        "payment_status", "needs_repayment",
        "payment_transaction_id", "transaction_type", "amount_krw",
        "event_id", "event_type", "event_time",
    ]
    renamed = {
        "payment_transaction_id": "latest_transaction_id",
        "transaction_type": "latest_transaction_type",
        "amount_krw": "latest_transaction_amount_krw",
        "event_id": "state_event_id",
        "event_type": "state_event_type",
        "event_time": "state_event_time",
    }
    requested = F.when(F.col("event_type") == "payment_requested", F.struct("event_time"))
    return (
        events.groupBy("payment_id")
        .agg(
            leading(LATEST_STATE, state).alias("s"),
            F.min(requested).alias("c"),  # event time leads the creation order, so the rest settles nothing
        )
        .select(
            "payment_id",
            *(F.col(f"s.row.{c}").alias(renamed.get(c, c)) for c in state),
            F.col("c").isNull().alias("is_orphan"),
            F.col("c.event_time").alias("requested_event_time"),
        )
        .select(*PAYMENTS_CURRENT)
    )


def ledger_replay(events: DataFrame) -> DataFrame:
    """Rebuild each event's summary from the movements so far and compare.

    ``needs_repayment`` is taken from the event; every other value is a running sum.
    """
    moved = F.col("amount_krw")
    replayed = running_sums(
        events.select(
            "payment_id", "event_id", "transaction_type", "amount_krw", "request_amount_krw",
            *SUMMARY_AMOUNTS, "payment_status", "needs_repayment", *(c for c, _ in CREATION),
        ),
        "payment_id",
        creation_buckets(),
        CREATION,
        {
            "replayed_payout": F.when(F.col("transaction_type") == "payment", moved),
            "replayed_refund": F.when(F.col("transaction_type") == "refund", moved),
        },
    ).withColumn("replayed_paid", F.col("replayed_payout") - F.col("replayed_refund"))
    request, paid = F.col("request_amount_krw"), F.col("replayed_paid")
    owing = F.col("needs_repayment") | (F.col("replayed_refund") == 0)
    replayed = replayed.withColumns(
        {
            "replayed_status": F.when(paid == request, "paid")
            .when(owing, "unpaid")
            .when(paid == 0, "refunded")
            .otherwise("partially_refunded"),
            "replayed_unpaid": F.when((paid != request) & owing, request - paid).otherwise(0),
        }
    )
    pairs = {
        "payout_amount_krw": "replayed_payout",
        "refund_amount_krw": "replayed_refund",
        "paid_amount_krw": "replayed_paid",
        "unpaid_amount_krw": "replayed_unpaid",
        "payment_status": "replayed_status",
    }
    agrees = ~any_of(*(~F.col(a).eqNullSafe(F.col(b)) for a, b in pairs.items()))
    return replayed.select(
        "payment_id", "event_id", "event_time", *pairs.values(), agrees.alias("agrees")
    )


def summary_violations(summaries: DataFrame) -> DataFrame:
    """Rows of a payment summary table that break an amount or state rule.

    A NULL predicate passes, as in a table check constraint.
    """
    request, payout = F.col("request_amount_krw"), F.col("payout_amount_krw")
    refund, paid = F.col("refund_amount_krw"), F.col("paid_amount_krw")
    broken = first_broken(
        [
            Rule("request_positive", request <= 0),
            *(Rule(f"{c.removesuffix('_amount_krw')}_nonnegative", F.col(c) < 0) for c in SUMMARY_AMOUNTS),
            Rule("net_amount_matches_movements", payout != paid + refund),
            Rule("paid_not_over_request", paid > request),
            Rule("status_matches_amounts", ~fits_a_state()),
            Rule(
                "repayment_requires_unpaid",
                F.col("needs_repayment") & (F.col("payment_status") != "unpaid"),
            ),
        ]
    )
    return summaries.withColumn("violation", broken).filter("violation IS NOT NULL")
