"""Namespaces and tables of the session's catalog: created if missing, else checked; appended by name."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlake.operators.expect import CheckFailed

#: Integers and decimals from narrow to wide; a value may go to a wider type only.
_WIDER = ["tinyint", "smallint", "int", "bigint"]
_FLOATS = ["float", "double"]


def _quoted(identifier: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in identifier.split("."))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ensure_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a namespace unless it exists."""
    where = f" LOCATION {_text(location)}" if location else ""
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {_quoted(name)}{where}")


def ensure_table(
    spark: SparkSession,
    identifier: str,
    schema: T.StructType,
    partitioned_by: Sequence[str] = (),
    properties: Mapping[str, str] | None = None,
    location: str | None = None,
) -> bool:
    """Create a Parquet table unless it exists; whether it was created.

    A table that exists keeps its properties and must have the same columns, types and partition
    columns (which come last); another one is refused.
    """
    if spark.catalog.tableExists(identifier):
        _require_same(spark, identifier, schema, partitioned_by)
        return False
    columns = ", ".join(
        f"{_quoted(f.name)} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema
    )
    clauses = [f"CREATE TABLE IF NOT EXISTS {_quoted(identifier)} ({columns}) USING parquet"]
    if partitioned_by:
        clauses.append(f"PARTITIONED BY ({', '.join(map(_quoted, partitioned_by))})")
    if location:
        clauses.append(f"LOCATION {_text(location)}")
    if properties:
        clauses.append(f"TBLPROPERTIES ({', '.join(f'{_text(k)} = {_text(v)}' for k, v in properties.items())})")
    spark.sql(" ".join(clauses))
    return True


def _require_same(spark: SparkSession, identifier: str, schema: T.StructType, partitioned_by: Sequence[str]) -> None:
    order = [f for f in schema if f.name not in partitioned_by] + [schema[c] for c in partitioned_by]
    wanted = [(f.name, f.dataType.simpleString(), f.name in partitioned_by) for f in order]
    found = [(c.name, c.dataType, c.isPartition) for c in spark.catalog.listColumns(identifier)]
    if found != wanted:
        missing, extra = ([f"{n} {t}" for n, t, _ in a if (n, t, _) not in b] for a, b in ((wanted, found), (found, wanted)))
        raise CheckFailed(f"{identifier} has another schema: missing {missing}, unexpected {extra}")


def widens(source: T.DataType, target: T.DataType) -> bool:
    """Whether every value of a type can be stored in another without loss."""
    if source == target or isinstance(source, T.NullType):
        return True
    if isinstance(source, T.DateType) and isinstance(target, T.TimestampType | T.TimestampNTZType):
        return True
    here, there = source.simpleString(), target.simpleString()
    if isinstance(source, T.DecimalType) and isinstance(target, T.DecimalType):
        whole = lambda t: t.precision - t.scale
        return target.scale >= source.scale and whole(target) >= whole(source)
    return any(
        here in names and there in names and names.index(here) <= names.index(there) for names in (_WIDER, _FLOATS)
    ) or (here in _WIDER[:3] and there == "double")


def append(df: DataFrame, identifier: str) -> None:
    """Append rows to a table, columns by name, whatever their order.

    Missing or unexpected columns are refused, and so is a column whose type could lose values in
    the table's. The check is the library's own, so it does not depend on session settings.
    """
    spark = df.sparkSession
    target = spark.table(identifier).schema
    if sorted(df.columns) != sorted(target.names):
        raise CheckFailed(f"columns {sorted(df.columns)} do not fit {identifier}: {sorted(target.names)}")
    narrowed = [
        f"{f.name} {df.schema[f.name].dataType.simpleString()} to {f.dataType.simpleString()}"
        for f in target
        if not widens(df.schema[f.name].dataType, f.dataType)
    ]
    if narrowed:
        raise CheckFailed(f"appending to {identifier} would narrow {', '.join(narrowed)}")
    df.select(*(df[name] for name in target.names)).write.insertInto(identifier)
