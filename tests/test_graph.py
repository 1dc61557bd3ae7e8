
import pytest
from fixtures import golden_events
from test_domains import AS_OF, BAD, T1, load, stored

from ledgerlake.plans import domains, graph

DOMAINS = {name: [stage.__name__ for stage in listed] for name, listed in domains.DOMAINS.items()}


@pytest.mark.parametrize(
    ("select", "expected"),
    [
        ("events_clean", {"events_clean"}),
        ("+bookings_current", {"events_clean", "booking_events_clean", "bookings_current"}),
        ("1+bookings_current", {"booking_events_clean", "bookings_current"}),
        ("booking_events_clean+", {"booking_events_clean", "bookings_current", "shop_daily_booking_metrics"}),
        ("events_clean+1,domain:payment", {"events_clean", "payment_events_clean"}),
        ("dim_shops payments_current", {"dim_shops", "payments_current"}),
        ("+dim_shops+", {"dim_shops", "shop_daily_booking_metrics"}),
        ("domain:gold", {"dim_shops", "shop_daily_booking_metrics"}),
        ("dim_shops,events_clean", set()),
    ],
)
def test_selectors(select, expected):
    found = graph.chosen(select, DOMAINS)
    assert set(found) == expected and len(found) == len(expected)
    order = graph.ordered()
    assert found == sorted(found, key=order.index)


@pytest.mark.parametrize("select", ["nothing", "domain:none", "events clean", "++events_clean", "tag:booking"])
def test_unknown_selectors_are_refused(select):
    with pytest.raises(ValueError, match="no stage is selected"):
        graph.chosen(select, DOMAINS)


def test_every_stage_follows_what_it_reads():
    order = graph.ordered()
    assert all(order.index(above) < order.index(name) for name, parents in graph.PARENTS.items() for above in parents)
    assert set(sum(DOMAINS.values(), [])) == set(graph.PARENTS)
    with pytest.raises(ValueError, match="cycle"):
        graph.ordered({"a": ("b",), "b": ("a",)})


def test_a_refusal_in_the_middle_skips_what_lies_behind(spark, tmp_path):
    root = str(tmp_path)
    load(spark, root, [BAD, *(e for e in golden_events() if e["event_type"].startswith("payment"))])
    found = {o.stage: o for o in domains.run_selected(spark, root, "events_clean+", AS_OF, T1)}
    assert {n for n, o in found.items() if o.status == "refused"} == {"booking_events_clean"}
    assert {n for n, o in found.items() if o.status == "skipped"} == {"bookings_current", "shop_daily_booking_metrics"}
    assert found["bookings_current"].reason == "behind booking_events_clean"
    assert found["payments_current"].report.stored_rows == 7
    assert stored(spark, root, "bookings_current") is None and stored(spark, root, "payments_current") is not None
    table = {r.stage: (r.status, r.stored_rows) for r in domains.outcomes(spark, list(found.values())).collect()}
    assert table["payments_current"] == ("done", 7) and table["bookings_current"] == ("skipped", None)
