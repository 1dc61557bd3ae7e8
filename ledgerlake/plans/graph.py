"""Which stage reads what, and the choice of stages by a selector.

A selector names stages of :data:`PARENTS`. ``name+`` adds all that depends on a stage, ``+name``
all that it depends on; a number limits the steps (``name+1``, ``2+name``). ``domain:booking``
stands for the stages of a domain. Words apart by spaces are united, parts of a word between
commas intersected.
"""

import re
from collections.abc import Iterable, Mapping
from graphlib import TopologicalSorter

#: The stages each stage reads.
PARENTS: dict[str, tuple[str, ...]] = {
    "events_clean": (),
    "booking_events_clean": ("events_clean",),
    "bookings_current": ("booking_events_clean",),
    "payment_events_clean": ("events_clean",),
    "payments_current": ("payment_events_clean",),
    "payment_transactions_clean": ("events_clean",),
    "booking_chain": ("events_clean",),
    "dim_shops": (),
    "shop_daily_booking_metrics": ("booking_events_clean", "dim_shops"),
}

_PART = re.compile(r"(?P<up>\d*\+)?(?P<name>[\w:]+)(?P<down>\+\d*)?")


def children(parents: Mapping[str, Iterable[str]]) -> dict[str, tuple[str, ...]]:
    below: dict[str, list[str]] = {name: [] for name in parents}
    for name, above in parents.items():
        for parent in above:
            below[parent].append(name)
    return {name: tuple(found) for name, found in below.items()}


def reach(start: Iterable[str], steps: Mapping[str, Iterable[str]], limit: int | None = None) -> set[str]:
    """All names within ``limit`` steps of ``start``, itself included."""
    found = edge = set(start)
    while edge and limit != 0:
        edge = {further for name in edge for further in steps[name]} - found
        found = found | edge
        limit = None if limit is None else limit - 1
    return found


def _steps(sign: str | None) -> int | None:
    digits = (sign or "").strip("+")
    return int(digits) if digits else None


def chosen(
    select: str, domains: Mapping[str, Iterable[str]], parents: Mapping[str, tuple[str, ...]] = PARENTS
) -> list[str]:
    """The stages of a selector, every one after those it reads."""
    below = children(parents)

    def part(text: str) -> set[str]:
        match = _PART.fullmatch(text)
        name = match["name"] if match else text
        kind, _, domain = name.partition(":")
        if match is None or (domain and (kind != "domain" or domain not in domains)) or (not domain and name not in parents):
            raise ValueError(f"no stage is selected by {text!r}")
        found = start = set(domains[domain]) if domain else {name}
        if match["up"]:
            found = found | reach(start, parents, _steps(match["up"]))
        if match["down"]:
            found = found | reach(start, below, _steps(match["down"]))
        return found

    wanted: set[str] = set()
    for word in select.split():
        wanted |= set.intersection(*map(part, word.split(",")))
    return [name for name in ordered(parents) if name in wanted]


def ordered(parents: Mapping[str, tuple[str, ...]] = PARENTS) -> list[str]:
    """All stages, every one after those it reads; a cycle is refused."""
    return list(TopologicalSorter(parents).static_order())
