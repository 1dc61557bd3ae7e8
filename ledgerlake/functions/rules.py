"""Ordered data contracts: the first broken rule names the error."""

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    code: str
    broken: Column


def first_broken(rules: list[Rule]) -> Column:
    """Error code of the first rule whose predicate is true, NULL when none is."""
    head, *tail = rules
    return reduce(
        lambda chain, rule: chain.when(rule.broken, rule.code),
        tail,
        F.when(head.broken, head.code),
    )


def any_of(*predicates: Column) -> Column:
    return reduce(or_, predicates)


def missing(*names: str) -> Column:
    return any_of(*(F.col(n).isNull() for n in names))


def blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(name) == "")


def not_positive(*names: str) -> Column:
    return any_of(*(F.col(n).isNull() | (F.col(n) <= 0) for n in names))


def negative(*names: str) -> Column:
    return any_of(*(F.col(n).isNull() | (F.col(n) < 0) for n in names))


def not_equal(name: str, value) -> Column:
    """Missing counts as different: plain ``<>`` would be NULL and let the row through."""
    return F.col(name).isNull() | (F.col(name) != value)
