"""JSON fields to typed columns, with "present but not castable" detection."""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"
_RAW = "_raw"


def json_schema(fields: dict[str, str], corrupt: bool = False) -> str:
    """Every leaf is read as text so that bad values stay visible; booleans stay boolean."""
    leaves = [f"{n} {'boolean' if t == 'boolean' else 'string'}" for n, t in fields.items()]
    return ", ".join([*leaves, f"{CORRUPT} string"] if corrupt else leaves)


def read_json(payload: Column, fields: dict[str, str], corrupt: bool = False) -> Column:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT} if corrupt else {}
    return F.from_json(payload, json_schema(fields, corrupt), options)


def with_json(
    df: DataFrame,
    before: Sequence[str],
    payload: Column,
    fields: dict[str, str],
    flag: str,
    after: Sequence[str],
    corrupt: bool = False,
) -> DataFrame:
    """Columns ``before``, the typed ``fields`` plus one boolean column ``flag``, columns ``after``.

    ``flag`` marks text that its type cannot hold, or with ``corrupt`` an unreadable
    payload. Both steps are generators: each payload is parsed once and casts stay there, while
    plain projections would be substituted into every later filter and parsed there again
    for every mention. The flag compares their results, so that no value is cast twice and the code
    generated for a wide contract stays small enough to be compiled.
    """
    parsed = F.struct(read_json(payload, fields, corrupt).alias(_RAW))
    raw = F.col(_RAW)

    def cast(name: str, kind: str) -> Column:
        return raw[name] if kind in ("string", "boolean") else raw[name].try_cast(kind)

    typed = F.struct(*(cast(n, kind).alias(n) for n, kind in fields.items()))
    if corrupt:
        bad = raw.isNull() | raw[CORRUPT].isNotNull()
    else:
        bad = reduce(
            or_,
            (
                raw[n].isNotNull() & F.col(n).isNull()
                for n, kind in fields.items()
                if kind not in ("string", "boolean")
            ),
        )
    shaped = df.select(*before, F.inline(F.array(parsed)), *after)
    shaped = shaped.select(*before, _RAW, F.inline(F.array(typed)), *after)
    return shaped.select(*before, *fields, bad.alias(flag), *after)
