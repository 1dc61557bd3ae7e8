"""Data tests: each returns the violating rows, so an empty result passes."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.rules import any_of
from ledgerlake.operators import bookings


class CheckFailed(RuntimeError):
    """A guard refused the run; the published table is unchanged."""


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(any_of(*(F.col(c).isNull() for c in columns)))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).count().filter("count > 1")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """Like :func:`duplicates` for a declared unique key, where NULL keys may repeat."""
    return duplicates(df.dropna(subset=list(keys)), *keys)


def accepted_values(df: DataFrame, column: str, values) -> DataFrame:
    """Values outside the list, with their count."""
    return df.filter(~F.col(column).isin(*values)).groupBy(column).count()


def check(df: DataFrame, name: str, holds: Column) -> DataFrame:
    """Rows for which a check constraint is false; NULL passes."""
    return df.filter(~holds).withColumn("violation", F.lit(name))


def disagreeing(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct non-NULL ``value``."""
    return (
        df.groupBy(key)
        .agg(F.min(value).alias("low"), F.max(value).alias("high"))
        .filter("low <> high")
    )


def contract_broken() -> Column:
    """Whether a clean booking event breaks the contract of its type."""
    return any_of(F.col("booking_id") <= 0, F.col("shop_id") <= 0, *(r.broken for r in bookings.contract()))


def booking_contract(events: DataFrame) -> DataFrame:
    """Clean booking events that break the contract of their type."""
    return events.filter(contract_broken())


def shop_dates(shops: DataFrame) -> DataFrame:
    """Shops that close before they open."""
    return shops.filter(F.col("closed_on") < F.col("opened_on")).select(
        "shop_id", "opened_on", "closed_on"
    )


def counts(df: DataFrame, key: str, expected: Mapping[str, int]) -> DataFrame:
    """Keys whose row count differs from the expected one."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(expected.items()), f"{key} string, expected long")
    actual = df.groupBy(key).agg(F.count("*").alias("actual"))
    return (
        wanted.join(actual, key, "full_outer")
        .fillna(0, ["expected", "actual"])
        .filter("expected <> actual")
    )


def key_coverage(source: DataFrame, output: DataFrame, key: str) -> DataFrame:
    """Keys that are not exactly once in ``output``, or missing on either side."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = source.select(key, one.alias("i"), zero.alias("o")).unionAll(
        output.select(key, zero.alias("i"), one.alias("o"))
    )
    return (
        sides.groupBy(key)
        .agg(F.max("i").alias("in_source"), F.sum("o").alias("in_output"))
        .filter("in_source <> 1 OR in_output <> 1")
    )


def row_checks(df: DataFrame, constraints: Mapping[str, Column]) -> DataFrame:
    """All named check constraints in one pass, one output row per broken constraint."""
    broken = F.array_compact(
        F.array(*(F.when(~holds, F.lit(name)) for name, holds in constraints.items()))
    )
    return df.select("*", F.explode(broken).alias("violation"))


def require_none(violations: DataFrame, message: str) -> None:
    if not violations.isEmpty():
        raise CheckFailed(message)


# --- fixed values: row constraints of the operational tables ---------------------
def shop_constraints() -> dict[str, Column]:
    return {"closes_after_opening": F.col("closed_on") >= F.col("opened_on")}


def service_constraints() -> dict[str, Column]:
    return {
        "price_nonnegative": F.col("list_price_krw") >= 0,
        "duration_positive": F.col("duration_minutes") > 0,
    }


def booking_constraints() -> dict[str, Column]:
    return {"price_nonnegative": F.col("booked_price_krw") >= 0}


def movement_constraints() -> dict[str, Column]:
    return {"amount_positive": F.col("amount_krw") > 0}


def outbox_constraints() -> dict[str, Column]:
    return {"schema_version_positive": F.col("schema_version") > 0}
