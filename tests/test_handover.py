"""Incidents and budgets of a tenant that is never quiet: slices that are handed on give what one walk gives."""

import datetime as dt
import random

import pytest

from beaconry.operators import alerts, incidents

T0 = dt.datetime(2026, 9, 1)
EVENT = "tenant_id string, at timestamp, event_id string, kind string, rule_id string, resource_id string, dedup_key string"
EDGE = "tenant_id string, source_id string, target_id string, kind string"
FIELDS = ("tenant_id", "event_id", "incident_id", "joined", "notify", "reason")


def grouped(spark, events, edges, seconds):
    found = incidents.incident_group(spark.createDataFrame(events, EVENT), spark.createDataFrame(edges, EDGE), slice_seconds=seconds)
    return sorted(map(tuple, found.select(*FIELDS).collect()))


def plain(events, edges):
    """One walk over each tenant's events in order."""
    out, near, above, below = [], {}, {}, {}
    for tenant, a, b, _ in edges:
        for here, there, side in ((a, b, above), (b, a, below)):
            near.setdefault((tenant, here), set()).add(there)
            side.setdefault((tenant, here), set()).add(there)
    for tenant in sorted({e[0] for e in events}):
        walk = incidents.Walk(True)
        for _, at, event, kind, rule, resource, key in sorted((e for e in events if e[0] == tenant), key=lambda e: (e[1], e[3] != "fire", e[2])):
            if kind == "clear":
                walk.settle(key)
            elif kind == "pending":
                walk.stir(key)
            else:
                sides = [s.get((tenant, resource), set()) for s in (near, above, below)]
                out.append((tenant, event, *walk.fire(event, at, rule, resource, key, *sides, any(t == tenant for t, *_ in edges))))
    return sorted(out)


def estate(tenants, n, rng):
    return [(t, f"{t}-d{i}", f"{t}-d{rng.randrange(i)}", "depends_on") for t in tenants for i in range(1, n) if rng.random() < 0.7]


@pytest.mark.parametrize("settled", [0.0, 0.4])
def test_a_month_without_quiet(spark, settled):
    """One tenant fires every minute for a month: many slices, a few rounds, the sequential walk's result."""
    rng = random.Random(3)
    events, rounds = [], []
    for minute in range(30 * 24 * 60 // 3):  # every third minute, still within the join window
        rule, resource = f"r{rng.randrange(4)}", f"t-d{rng.randrange(40)}"
        key = f"{rule}/{resource}"
        events.append(("t", T0 + dt.timedelta(minutes=3 * minute), f"e{minute:06}", "fire", rule, resource, key))
        if rng.random() < settled:
            events.append(("t", T0 + dt.timedelta(minutes=3 * minute + 2), f"c{minute:06}", "clear", rule, resource, key))
    edges = estate("t", 40, rng)
    held = incidents.cut_lineage

    def counted(df):
        if "end" in df.columns:
            rounds.append(1)
        return held(df)

    incidents.cut_lineage = counted
    try:
        got = grouped(spark, events, edges, 6 * 3600)
    finally:
        incidents.cut_lineage = held
    assert got == plain(events, edges)
    print("slices", 120, "rounds", len(rounds))
    assert len(rounds) <= 30  # of 120 slices, one by one, if nothing were guessed


def test_busy_and_quiet_tenants(spark):
    """Storms, lulls, settled and stirred alerts, and equal instants, in slices shorter and longer than the join window."""
    rng = random.Random(4)
    events, at = [], T0
    for i in range(900):
        at += dt.timedelta(seconds=rng.choice([0, 0, 20, 60, 200, 290, 301, 900] if i % 97 else [4000]))
        tenant, rule = rng.choice(["t", "u"]), f"r{rng.randrange(8)}"
        resource = f"{tenant}-d{rng.randrange(30)}"
        events.append((tenant, at, f"e{i:05}", rng.choice(["fire"] * 4 + ["clear", "pending"]), rule, resource, f"{rule}/{resource}"))
    edges = estate("t", 30, rng)
    want = plain(events, edges)
    for seconds in (120, 3600):
        assert grouped(spark, events, edges, seconds) == want


ATTEMPT = "tenant_id string, channel_id string, attempt_id long, at timestamp, label string"


def throttled(attempts, budget, cap):
    """One walk over each tenant's attempts in order."""
    out, sent, recent = {}, {}, {}
    for tenant, channel, number, at, _ in sorted(attempts, key=lambda a: (a[3], a[2])):
        day, held = (tenant, at.date()), recent.setdefault((tenant, channel), [])
        held[:] = [s for s in held if s > at - dt.timedelta(minutes=1)]
        if sent.get(day, 0) >= budget[tenant]:
            out[number] = "over_budget"
        elif len(held) >= cap[channel]:
            out[number] = "rate_limited"
        else:
            out[number] = "sent"
            sent[day] = sent.get(day, 0) + 1
            held.append(at)
    return out


def budgeted(spark, attempts, budget, cap, seconds):
    budgets = spark.createDataFrame(list(budget.items()), "tenant_id string, budget_per_day int")
    channels = spark.createDataFrame([(t, c, n) for t in budget for c, n in cap.items()], "tenant_id string, channel_id string, max_per_minute int")
    got = alerts.notify_throttle(spark.createDataFrame(attempts, ATTEMPT), budgets, channels, seconds)
    assert got.columns == ["tenant_id", "channel_id", "attempt_id", "at", "label", "outcome"]
    return {r.attempt_id: r.outcome for r in got.collect()}


def test_budgets_of_a_month_without_quiet(spark):
    """One channel attempts every minute or less for a month; every slice is its own group of a task."""
    rng, at, attempts = random.Random(6), T0, []
    while at < T0 + dt.timedelta(days=30):
        attempts.append(("t", "c", len(attempts), at, None))
        at += dt.timedelta(seconds=rng.choice([25, 40, 59, 60]))
    want = throttled(attempts, {"t": 900}, {"c": 1})
    assert set(want.values()) == {"sent", "rate_limited", "over_budget"}
    assert budgeted(spark, attempts, {"t": 900}, {"c": 1}, 6 * 3600) == want


def test_budgets_of_channels_held_at_their_limit(spark):
    """Storms over hours and midnights, at a rate whose phase never meets: with a budget that ends in the last minute
    of a day, one that never ends, and none; equal instants, several sends a minute, and a cap of nothing."""
    rng, attempts = random.Random(7), []
    for tenant, channel, step, hours in (("t", "a", 7, 52), ("t", "b", 31, 30), ("u", "a", 11, 50), ("u", "none", 600, 20), ("v", "b", 60, 5)):
        at = T0 + dt.timedelta(hours=18, seconds=rng.randrange(60))
        end = at + dt.timedelta(hours=hours)
        while at < end:
            attempts.append((tenant, channel, len(attempts), at, "x"))
            if rng.random() < 0.05:
                attempts.append((tenant, channel, len(attempts), at, None))
            at += dt.timedelta(seconds=step, milliseconds=rng.randrange(3))
    cap = {"a": 2, "b": 1, "none": 0}
    spent = throttled(attempts, {"t": 10**6, "u": 10**6, "v": 0}, cap)
    first_day = sum(spent[n] == "sent" for t, _, n, at, _ in attempts if t == "t" and at.date() == T0.date())
    for budget in ({"t": first_day - 1, "u": 10**6, "v": 0}, {"t": first_day, "u": 1500, "v": 3}):
        want = throttled(attempts, budget, cap)
        assert budgeted(spark, attempts, budget, cap, 1800) == want


def test_slices_divide_a_day(spark):
    with pytest.raises(ValueError):
        budgeted(spark, [("t", "c", 1, T0, None)], {"t": 1}, {"c": 1}, 7000)
    assert budgeted(spark, [("w", "c", 1, T0, None)], {"t": 1}, {"c": 1}, 3600) == {}


def test_a_slice_is_handed_no_more_than_its_rows_name(spark, monkeypatch):
    """An incident that is open for days holds ever more; what slices begin with does not grow with it."""
    events = [("t", T0 + dt.timedelta(minutes=2 * i), f"e{i:05}", "fire", "r", f"t-d{i}", f"r/{i}") for i in range(1500)]
    events += [("t", T0 + dt.timedelta(minutes=2 * i + 1), f"c{i:05}", "clear", "r", f"t-d{i}", f"r/{i}") for i in range(0, 1500, 3)]
    edges = [("t", f"t-d{i}", f"t-d{i // 2}", "depends_on") for i in range(1, 1500)]
    starts, held = [], incidents.cut_lineage

    def seen(df):
        out = held(df)
        if "start" in out.columns:
            starts.extend(len(r.start) for r in out.collect())
        return out

    monkeypatch.setattr(incidents, "cut_lineage", seen)
    assert grouped(spark, events, edges, 3600) == plain(events, edges)
    assert max(starts) < 6000  # of an incident with 1500 members at the end
