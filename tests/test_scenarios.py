"""Small cases with known answers, and hard operators against plain Python."""

import datetime as dt
import ipaddress
import json
import os
import random
import time
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from beaconry.functions import predicates as p
from beaconry.functions import series
from beaconry.functions.quantiles import exact_quantiles
from beaconry.functions.scalars import address_key, attr, ip_scope, severity_num, time_bucket
from beaconry.operators import (
    addresses, alerts, devices, graph, identity, incidents, maintenance, query, rates, rollups, security, selectors, traces,
)
from beaconry.sources import otlp, signals, syslog
from beaconry.streaming import stateful
from beaconry.streaming.tail import poll

T0 = dt.datetime(2026, 9, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- predicates ---


def test_refusals(spark):
    df = frame(spark, [("a", 1.0)], "body string, value double")
    for bad in (
        lambda: p.time_window("t", at(5), at(5)),
        lambda: p.compare("value", "eq", float("nan")),
        lambda: p.compare("value", "eq", [1]),
        lambda: p.is_in("value", []),
        lambda: p.all_of(),
        lambda: p.text_search(["x"], "phrase", "summary"),
        lambda: p.text_search([], "substring"),
        lambda: p.exists(df, "value"),
        lambda: query.check_alias("1; drop"),
        lambda: query.aggregate(df, {}, ["body"]),
        lambda: query.aggregate(df, {"n": query.Agg("count", "value")}),
        lambda: query.ordered(df, [("nothing", True)]),
        lambda: query.limited(df, 0),
        lambda: time_bucket("t", 0),
        lambda: time_bucket("t", 86_401),
        lambda: selectors.select_tagged(df, "", "x"),
    ):
        with pytest.raises(ValueError):
            bad()
    assert query.limited(spark.range(20_000), 15_000).count() == 15_000


def test_missing_key_reads_empty_and_severity_is_ordinal(spark):
    df = frame(spark, [({"a": "1"}, "warn"), ({}, "alert")], "m map<string,string>, severity string")
    assert df.where(attr("m", "a") != "1").count() == 1
    assert rows(df.where(severity_num("severity") >= 6), "severity") == [("alert",)]


def test_window_is_half_open_and_an_empty_selector_selects_nothing(spark):
    df = frame(spark, [("t", "r", at(0)), ("t", "r", at(60))], "tenant_id string, resource_id string, observed_at timestamp")
    assert query.read(df, "t", start=at(0), end=at(60)).count() == 1
    none = df.where("false").select("tenant_id", "resource_id")
    assert query.read(df, "t", resources=none).count() == 0
    assert query.read(df, "other").count() == 0


def test_address_scopes(spark):
    cases = {
        "172.15.0.1": "public", "172.16.0.1": "private", "172.31.9.9": "private", "172.32.0.1": "public",
        "100.63.0.1": "public", "100.64.0.1": "carrier_grade", "100.127.0.1": "carrier_grade", "192.168.0.1": "private",
        "169.254.1.1": "link_local", "127.9.9.9": "loopback", "::1": "unknown", "1.2.3.256": "unknown",
    }
    df = frame(spark, [(a,) for a in cases], "a string").select("a", ip_scope("a").alias("s"))
    assert {r.a: r.s for r in df.collect()} == cases


# --- series: one hot series cut into many slices gives what one window gives ---


def test_sliced_series_match_plain_ones(spark):
    rng = random.Random(7)
    data, clock = [], {"hot": 0, "cold": 0}
    for i in range(400):
        key = "hot" if rng.random() < 0.9 else "cold"
        clock[key] += rng.choice([1, 5, 400, 9000])
        data.append((key, at(clock[key]), i, rng.randint(0, 9)))
    df = frame(spark, data, "k string, t timestamp, i long, v long")
    lagged = series.with_previous(df, ["k"], ["t", "i"], ["v"], "prev", slice_seconds=600)
    topped = series.with_running_max(df, ["k"], ["t", "i"], F.col("v"), "top", slice_seconds=600)
    summed = series.with_running_sum(df, ["k"], ["t", "i"], F.col("v"), "total", slice_seconds=600)
    got = {r.i: [r.prev.v if r.prev else None] for r in lagged.collect()}
    for r in topped.collect():
        got[r.i].append(r.top)
    for r in summed.collect():
        got[r.i].append(r.total)
    seen = {}
    for k, _, i, v in sorted(data, key=lambda d: (d[0], d[1], d[2])):
        last, top, total = seen.get(k, (None, -1, 0))
        top, total = max(top, v), total + v
        assert got[i] == [last, top, total]
        seen[k] = (v, top, total)


def test_exact_quantiles(spark):
    rng = random.Random(3)
    data = [("g", rng.uniform(-50, 5000)) for _ in range(997)] + [("same", 4.0)] * 50 + [("one", -2.5), ("none", None), (None, 8.0), (None, 9.0)]
    df = frame(spark, data, "g string, v double")
    got = exact_quantiles(df, ["g"], "v", {"lo": 0.0, "mid": 0.5, "hi": 0.99}, count="n")
    for r in got.collect():
        v = pd.Series([x for g, x in data if g == r.g and x is not None])
        assert r.n == len(v)
        for name, q in (("lo", 0.0), ("mid", 0.5), ("hi", 0.99)):
            assert r[name] == pytest.approx(v.quantile(q), abs=1e-9)
    assert got.count() == 4, "a null key is a group, and a group without values is none"


def test_exact_quantiles_of_long_integers(spark):
    """Neighbours beyond 2^53 share a double, and the range of a long has no room for their differences."""
    big = 2**53
    data = [("near", big + i) for i in range(9)] + [("far", -(2**63)), ("far", 2**63 - 1), ("far", 7)] + [("two", big + 1), ("two", big + 4)]
    df = frame(spark, data * 2, "g string, v long")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"lo": 0.25, "mid": 0.5, "hi": 0.75}, count="n").collect()}
    assert {g: r.n for g, r in got.items()} == {"near": 18, "far": 6, "two": 4}
    for g, r in got.items():
        v = sorted(x for k, x in data * 2 if k == g)
        for name, q in (("lo", Fraction(1, 4)), ("mid", Fraction(1, 2)), ("hi", Fraction(3, 4))):
            place = q * (len(v) - 1)
            low = v[int(place)]
            want = low + (v[min(int(place) + 1, len(v) - 1)] - low) * (place - int(place))
            assert r[name] == float(want)


def test_one_pass_for_quantiles_of_one_expression(spark):
    df = frame(spark, [("a", i) for i in range(11)], "g string, v long")
    asked = lambda *names: query.aggregate(df, {n: query.Agg(n, F.col("v") * 2) for n in names}, ["g"], ["g"])
    read = lambda got: got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert rows(asked("p50", "p95"), "g", "p50", "p95") == [("a", 10.0, 19.0)]
    assert read(asked("p50", "p95", "p99")) == read(asked("p50"))


def test_first_per_group(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") % 10 < 9, "hot").otherwise("cold"))
    got = series.first_per_group(df, ["k"], [F.col("id").desc()], 3)
    assert rows(got, "k", "id") == [("cold", 979), ("cold", 989), ("cold", 999), ("hot", 996), ("hot", 997), ("hot", 998)]


# --- counters and states ---

METRIC = "tenant_id string, resource_id string, metric string, observed_at timestamp, ingested_at timestamp, value double, labels map<string,string>"


def test_rates(spark):
    def sample(name, second, value):
        return ("t", "r", "io", at(second), at(second), float(value), {"if": name})

    df = frame(spark, [sample("a", 0, 100), sample("a", 10, 300), sample("a", 20, 50), sample("a", 20, 60), sample("b", 5, 999)], METRIC)
    got = rates.counter_rate(df.withColumn("n", F.monotonically_increasing_id()), tie=["value"])
    found = {(r.labels["if"], r.observed_at, r.value): r.rate for r in got.collect()}
    assert found[("a", at(0), 100.0)] is None
    assert found[("a", at(10), 300.0)] == 20.0
    assert found[("a", at(20), 50.0)] is None, "a value that went backwards has no rate"
    assert found[("a", at(20), 60.0)] is None, "time that did not advance has no rate"
    assert found[("b", at(5), 999.0)] is None, "another interface is another series"
    steps = {r.value: r.step for r in rates.counter_step_class(df, 32, 30, tie=["value"]).collect()}
    assert steps == {100.0: None, 300.0: "rate", 50.0: "wrapped", 60.0: "no_time", 999.0: None}
    wide = {r.value: r.step for r in rates.counter_step_class(df, 64, 30, tie=["value"]).collect()}
    assert wide[50.0] == "reset"


def test_a_change_out_of_maintenance_is_swallowed_once(spark):
    inventory = frame(spark, [("t", "d", "maintenance")], "tenant_id string, id string, status string")
    schema = "tenant_id string, resource_id string, observed_at timestamp, ingested_at timestamp, severity string, previous_status string, current_status string"
    readings = frame(spark, [("t", "d", at(i), at(i), "", "", s) for i, s in enumerate(["down", "down", "up"])], schema)
    got = rates.state_transitions(readings, inventory)
    assert rows(got, "previous_status", "current_status", "severity") == [("down", "up", "info")]


def test_distinct_in_merged_states(spark):
    """Sketches of five minutes, merged over repeats and buckets, stay within three standard errors of the truth."""
    days = spark.range(400_000).select(
        (F.col("id") % 2).cast("string").alias("tenant_id"), F.when(F.col("id") % 10 > 0, F.col("id") % 60_000).alias("user"),
        F.timestamp_seconds(F.col("id") % 7200).alias("observed_at"),
    )
    state = rollups.rollup_distinct_5m(days, ["tenant_id"], "user")
    assert state.count() == 48
    merged = rollups.merge_states("distinct", state.unionByName(state))
    assert merged.count() == 48
    exact = {r.tenant_id: r.n for r in days.groupBy("tenant_id").agg(F.count_distinct("user").alias("n")).collect()}
    for r in rollups.read_rollup_distinct(merged, ["tenant_id"]).collect():
        assert abs(r["distinct"] - exact[r.tenant_id]) <= 3 * 1.04 / 2**6 * exact[r.tenant_id]
    few = days.where("user < 50 or user is null")
    got = rollups.read_rollup_distinct(rollups.rollup_distinct_5m(few, ["tenant_id"], "user"), ["tenant_id"])
    want = few.groupBy("tenant_id").agg(F.count_distinct("user").alias("n"))
    assert rows(got, "tenant_id", "distinct") == rows(want, "tenant_id", "n")
    with pytest.raises(ValueError):
        rollups.read_rollup_distinct(merged, ["user"])


def test_rollups(spark):
    schema = "tenant_id string, resource_id string, observed_at timestamp, src_address string, dst_address string, dst_port int, protocol int, sampling_rate long, bytes long, packets long"
    flows = frame(spark, [("t", "r", at(i), "a", "b", 1, 6, rate, 10, 1) for i, rate in enumerate([1, 64, 64])], schema)
    rolled = rollups.rollup_flows_5m(flows)
    assert rows(rolled, "sampling_rate", "bytes", "records") == [(1, 10, 1), (64, 20, 2)]
    with pytest.raises(ValueError):
        rollups.read_rollup_flows(rolled, ["src_address"])
    with pytest.raises(ValueError):
        rollups.read_rollup_metrics(rolled, ["labels"])
    with pytest.raises(ValueError):
        rollups.read_rollup_logs(rolled, ["resource_id"], ["p95"])
    with pytest.raises(ValueError):
        rollups.read_rollup_service(rolled, ["tenant_id"], [0.42])


def test_service_sketch_is_close(spark):
    spans = spark.range(20_000).select(
        F.lit("t").alias("tenant_id"), F.lit("s").alias("service_id"), F.lit("n").alias("name"), F.lit("k").alias("kind"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("observed_at"), F.lit("ok").alias("status_code"),
        (F.col("id") * 7919 % 20_000).alias("duration_ns"),
    )
    got = rollups.read_rollup_service(rollups.rollup_service_5m(spans), ["tenant_id", "service_id"]).first()
    assert got.requests == 20_000 and got.errors == 0
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert abs(got[name] / 20_000 - q) < 0.02


# --- alerts ---


def machine(evaluations, hold):
    """The phases of one series, a step at a time."""
    phase, since, out = "ok", None, []
    for t, breach in evaluations:
        was = phase
        if breach and was == "firing":
            pass
        elif breach:
            start = since if was == "pending" else t
            fires = (t - start).total_seconds() >= hold if was == "pending" else hold <= 0
            phase, since = ("firing", t) if fires else ("pending", start)
        else:
            phase, since = ("resolved" if was == "firing" else "ok"), t
        out.append((phase, since, phase != was and phase in ("firing", "resolved")))
    return out


def test_phases_match_the_machine(spark):
    rng = random.Random(11)
    data, expected, n = [], {}, 0
    for s in range(60):
        hold, t, steps = rng.choice([0, 60, 120, 300]), 0, []
        for _ in range(40):
            t += rng.choice([30, 60, 60, 4000])
            steps.append((at(t), rng.random() < 0.6))
        for (when, breach), want in zip(steps, machine(steps, hold), strict=True):
            data.append(("t", f"k{s}", n, when, breach, hold))
            expected[n] = want
            n += 1
    df = frame(spark, data, "tenant_id string, dedup_key string, n long, at timestamp, breaching boolean, hold_seconds long")
    got = alerts.alert_phases(df, order=["at", "n"]).collect()
    assert {r.n: (r.phase, r.since, r.notify) for r in got} == expected


def test_hold_is_met_exactly(spark):
    data = [("t", "k", at(s), True, 300) for s in (0, 299, 300)]
    df = frame(spark, data, "tenant_id string, dedup_key string, at timestamp, breaching boolean, hold_seconds long")
    assert [r.phase for r in alerts.alert_phases(df).orderBy("at").collect()] == ["pending", "pending", "firing"]


def test_absence_needs_an_expected_set_and_sees_the_never_heard(spark):
    heard = frame(spark, [("t", "a", at(0))], "tenant_id string, resource_id string, observed_at timestamp")
    rules = frame(spark, [("t", "r", 30)], "tenant_id string, rule_id string, after_seconds long")
    expected = frame(spark, [("t", "r", "a"), ("t", "r", "b")], "tenant_id string, rule_id string, resource_id string")
    now = F.lit(at(20)).cast("timestamp")
    with pytest.raises(ValueError):
        alerts.absence_values(heard, rules, None, now)
    assert rows(alerts.absence_values(heard, rules, expected, now), "resource_id", "value", "breaching") == [("a", 20.0, False), ("b", 61.0, True)]


def test_stream_absence_tells_each_silence_and_the_never_heard(spark, tmp_path):
    schema = "tenant_id string, resource_id string, observed_at timestamp"
    source, names, out, progress = (str(tmp_path / n) for n in ("source", "names", "out", "progress"))
    heard = lambda data: frame(spark, data, schema).write.mode("append").parquet(source)
    heard([("t", "a", at(0)), ("t", "a", at(9)), ("t", "b", at(5))])
    watched = frame(spark, [("t", "a"), ("t", "never"), ("u", "a")], "tenant_id string, resource_id string")
    watched.write.parquet(names)
    read = lambda path, schema: spark.readStream.schema(schema).parquet(path)
    live = read(source, schema)
    for none in (None, watched):
        with pytest.raises(ValueError):
            stateful.stream_absence(live, none, 2)
    silences = stateful.stream_absence(live, read(names, watched.schema), 2)
    running = silences.writeStream.option("checkpointLocation", progress).trigger(processingTime="1 second").start(out)

    def told(wanted):
        """What was told once there is as much as is wanted, and a little later."""
        began, found = time.monotonic(), set()
        while len(found) < wanted and time.monotonic() - began < 90 and not running.awaitTermination(1):
            found = {*map(tuple, spark.read.schema(silences.schema).parquet(out).collect())} if os.path.exists(f"{out}/_spark_metadata") else set()
        running.awaitTermination(4)
        return spark.read.schema(silences.schema).parquet(out).collect()

    key = lambda r: (r.tenant_id, r.resource_id, r.last_seen or at(-1))
    first = [("t", "a", at(9)), ("t", "b", at(5)), ("t", "never", at(-1)), ("u", "a", at(-1))]
    assert sorted(map(key, told(4))) == first
    heard([("t", "never", at(60)), ("t", "a", at(61))])
    assert sorted(map(key, told(6))) == sorted([*first, ("t", "never", at(60)), ("t", "a", at(61))])
    running.stop()


def test_dedup_key_escapes_and_sorts(spark):
    df = frame(spark, [({"b": "x,y", "a": "1=2\\"},), ({},)], "labels map<string,string>")
    got = [r[0] for r in df.select(alerts.dedup_key(F.lit("r"), F.lit("d"), "labels")).collect()]
    assert got == ["r/d/a=1\\=2\\\\,b=x\\,y", "r/d"]


def test_throttle_matches_a_walk(spark):
    rng = random.Random(5)
    data = [("t" + str(i % 2), "c" + str(rng.randint(0, 1)), i, at(rng.randint(0, 3 * 86_400) // 7 * 7)) for i in range(600)]
    data += [("t0", "c0", 1000 + i, at(86_390 + i * 3)) for i in range(20)]
    df = frame(spark, data, "tenant_id string, channel_id string, attempt_id long, at timestamp")
    budgets = frame(spark, [("t0", 25), ("t1", 400)], "tenant_id string, budget_per_day int")
    channels = df.select("tenant_id", "channel_id").distinct().withColumn("max_per_minute", F.lit(1))
    got = {r.attempt_id: r.outcome for r in alerts.notify_throttle(df, budgets, channels, slice_seconds=7200).collect()}
    budget, sent, recent = {"t0": 25, "t1": 400}, {}, {}
    for tenant, channel, n, when in sorted(data, key=lambda d: (d[3], d[2])):
        last_minute = [s for s in recent.get((tenant, channel), []) if s > when - dt.timedelta(minutes=1)]
        if sent.get((tenant, when.date()), 0) >= budget[tenant]:
            want = "over_budget"
        elif last_minute:
            want = "rate_limited"
        else:
            want = "sent"
            sent[(tenant, when.date())] = sent.get((tenant, when.date()), 0) + 1
            recent.setdefault((tenant, channel), []).append(when)
        assert got[n] == want
    assert set(got.values()) == {"sent", "rate_limited", "over_budget"}


# --- maintenance ---

WINDOW = "starts_at timestamp, duration_minutes int, timezone string, recurrence string, weekday int, day int, until timestamp"


def is_open(spark, window, moment):
    df = frame(spark, [window], WINDOW)
    return df.select(maintenance.is_open(F.lit(moment).cast("timestamp"))).first()[0]


def test_windows(spark):
    once = (dt.datetime(2026, 9, 19, 20), 120, "Asia/Dhaka", "once", None, None, None)
    assert [is_open(spark, once, f"2026-09-19 {t}") for t in ("19:59:59", "20:00:00", "21:59:59", "22:00:00")] == [False, True, True, False]
    assert not is_open(spark, once, "2026-09-26 21:00:00")
    # Two in the morning in London, in summer and in winter.
    weekly = (dt.datetime(2026, 9, 6, 1), 60, "Europe/London", "weekly", 6, None, None)
    assert is_open(spark, weekly, "2026-09-13 01:30:00") and is_open(spark, weekly, "2026-11-08 02:30:00")
    assert not is_open(spark, weekly, "2026-11-08 01:30:00")
    # Spring forward skips 01:30 on 28 March 2027; fall back takes the first 01:30.
    daily = (dt.datetime(2026, 9, 1, 0, 30), 30, "Europe/London", "daily", None, None, None)
    assert not is_open(spark, daily, "2027-03-28 00:45:00") and not is_open(spark, daily, "2027-03-28 01:45:00")
    assert is_open(spark, daily, "2026-10-25 00:40:00") and not is_open(spark, daily, "2026-10-25 01:40:00")
    # A month without the day is passed over, and a window may outlast a day.
    monthly = (dt.datetime(2026, 8, 31, 0), 60, "UTC", "monthly", None, 31, None)
    assert is_open(spark, monthly, "2026-10-31 00:10:00") and not is_open(spark, monthly, "2026-09-30 00:10:00")
    long = (dt.datetime(2026, 9, 7, 0), 3 * 24 * 60, "UTC", "weekly", 0, None, None)
    assert is_open(spark, long, "2026-09-09 23:59:00") and not is_open(spark, long, "2026-09-10 00:00:00")
    ended = (dt.datetime(2026, 9, 1), 60, "UTC", "daily", None, None, dt.datetime(2026, 9, 3))
    assert not is_open(spark, ended, "2026-09-05 00:10:00")
    assert not is_open(spark, (dt.datetime(2026, 9, 1), 60, "Mars/Base", "daily", None, None, None), "2026-09-01 00:10:00")


# --- incidents ---

EVENT = "tenant_id string, at timestamp, event_id string, kind string, rule_id string, resource_id string, dedup_key string"
EDGE = "tenant_id string, source_id string, target_id string, kind string"


def grouped(spark, events, edges, suppress=True):
    df = frame(spark, [("t", at(s), e, k, r, d, f"{r}/{d}") for s, e, k, r, d in events], EVENT)
    links = frame(spark, [("t", a, b, k) for a, b, k in edges], EDGE)
    got = incidents.incident_group(df, links, suppress, slice_seconds=100).collect()
    return {r.event_id: (r.incident_id.removeprefix("incident-"), r.notify, r.reason) for r in got}


def test_grouping(spark):
    # A host below an access switch, which is below a core; another host beside it; one elsewhere.
    edges = [("h1", "sw", "depends_on"), ("h2", "sw", "depends_on"), ("sw", "core", "depends_on"), ("x", "y", "connected_to")]
    got = grouped(
        spark,
        [
            (0, "a", "fire", "r1", "sw"), (60, "b", "fire", "r2", "h1"), (120, "c", "fire", "r2", "x"), (130, "d", "fire", "r3", "y"),
            (200, "e", "fire", "r4", "core"), (501, "f", "fire", "r5", "h2"),
        ],
        edges,
    )
    assert got["a"] == ("a", True, "nothing_recent")
    assert got["b"] == ("a", False, "connected_1"), "below a known member, so silent"
    assert got["c"] == ("a", False, "same_rule"), "the same rule joins whatever the topology"
    assert got["d"] == ("a", True, "connected_1")
    assert got["e"] == ("a", True, "connected_1"), "above what is known, so it speaks"
    # More than five minutes after the last alert the incident takes no more.
    assert got["f"] == ("f", True, "nothing_recent")


def test_two_hops_and_settling(spark):
    edges = [("h1", "sw", "depends_on"), ("h2", "sw", "depends_on")]
    got = grouped(
        spark,
        [
            (0, "a", "fire", "r1", "h1"), (10, "b", "fire", "r2", "h2"), (20, "k1", "clear", "r1", "h1"), (20, "k2", "clear", "r2", "h2"),
            (30, "c", "fire", "r1", "h2"), (40, "d", "fire", "r9", "far"),
        ],
        edges,
    )
    assert got["b"] == ("a", True, "connected_2")
    assert got["c"] == ("c", True, "nothing_recent"), "a settled incident takes no more"
    assert got["d"] == ("d", True, "not_connected")
    assert grouped(spark, [(0, "a", "fire", "r1", "h1"), (1, "b", "fire", "r2", "h2")], [("z", "z", "runs")][:0]) == {
        "a": ("a", True, "no_topology"), "b": ("b", True, "no_topology")
    }


def test_candidate(spark):
    edges = frame(spark, [("t", "h", "sw", "depends_on"), ("t", "a", "b", "runs"), ("t", "b", "a", "runs")], EDGE)
    schema = "tenant_id string, incident_id string, resource_id string, first_alert_at timestamp"
    members = frame(
        spark,
        [
            ("t", "i1", "h", at(0)), ("t", "i1", "sw", at(9)), ("t", "i2", "p", at(0)), ("t", "i2", "q", at(0)),
            ("t", "i3", "a", at(0)), ("t", "i3", "b", at(1)), ("u", "i4", "only", at(0)), ("u", "i5", "m", at(0)), ("u", "i5", "n", at(1)),
        ],
        schema,
    )
    got = {r.incident_id: (r.candidate_id, r.absent_because) for r in incidents.incident_candidate(members, edges).collect()}
    assert got == {
        "i1": ("sw", None), "i2": (None, "disconnected"), "i3": (None, "disconnected"), "i4": ("only", None), "i5": (None, "no_topology"),
    }


# --- graphs and traces ---


def test_walks_end_on_a_cycle_and_components_are_found(spark):
    edges = frame(spark, [("t", "b", "a", "runs"), ("t", "c", "b", "runs"), ("t", "a", "c", "runs"), ("t", "d", "a", "member_of")], EDGE)
    inventory = frame(spark, [("t", x) for x in "abcde"], "tenant_id string, id string")
    roots = frame(spark, [("t", "a"), ("t", "ghost"), ("u", "a")], "tenant_id string, resource_id string")
    assert rows(graph.walk_dependents(edges, inventory, roots, 9), "resource_id", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    chain = [("t", f"n{i:03}", f"n{i + 1:03}", "connected_to") for i in range(60) if i % 20 != 19]
    nodes = frame(spark, [("t", f"n{i:03}") for i in range(61)], "tenant_id string, id string")
    got = graph.components(nodes, frame(spark, chain, EDGE))
    assert {(r.component_id, r["size"]) for r in got.collect()} == {("n000", 20), ("n020", 20), ("n040", 20), ("n060", 1)}


SPAN = "tenant_id string, trace_id string, span_id string, parent_span_id string, observed_at timestamp, duration_ns long, status_code string, service_id string"


def test_trace_with_orphan_and_cycle(spark):
    def span(name, parent, second, ms):
        return ("t", "x", name, parent, at(second), ms * 1_000_000, "ok", "s")

    spans = [
        span("root", "", 0, 900), span("kid", "root", 1, 100), span("slow", "root", 2, 300), span("leaf", "slow", 3, 50),
        span("lost", "gone", 4, 10), span("self", "self", 5, 5),
        span("c1", "c3", 7, 1), span("c2", "c1", 6, 1), span("c3", "c2", 8, 1), span("tail", "c3", 5, 1),
    ]
    got = {r.span_id: (r.root, r.depth, r.orphaned, r.critical) for r in traces.trace_tree(frame(spark, spans, SPAN)).collect()}
    assert got == {
        "root": ("root", 0, False, True), "kid": ("root", 1, False, False), "slow": ("root", 1, False, True),
        "leaf": ("root", 2, False, True), "lost": ("lost", 0, True, False), "self": ("self", 0, True, False),
        # The earliest of the cycle becomes its root; a tail that is earlier still is its own.
        "c2": ("c2", 0, True, False), "c3": ("c2", 1, False, False), "c1": ("c2", 2, False, False), "tail": ("tail", 0, True, False),
    }


def test_repeated_spans_are_one_node(spark):
    """At-least-once delivery: ten copies of each span of a chain of fifty."""
    chain = [("t", "x", f"s{i:02}", f"s{i - 1:02}" if i else "", at(i), 1_000_000, "ok", "s") for i in range(50)]
    bare = ("t", "x", "", "s03", at(60), 5, "ok", "s")
    got = traces.trace_tree(frame(spark, chain * 10 + [bare] * 3, SPAN)).collect()
    assert len(got) == 51
    assert {r.span_id: (r.root, r.depth) for r in got} == {**{f"s{i:02}": ("s00", i) for i in range(50)}, None: ("s00", 4)}
    summary = traces.trace_summary(frame(spark, chain * 2, SPAN), frame(spark, [("t", "x"), ("t", "y")], "tenant_id string, trace_id string"))
    assert {r.trace_id: (r.spans, r.kind) for r in summary.collect()} == {"x": (50, "complete"), "y": (0, "empty")}


def test_a_histogram_counts_every_row(spark):
    first = dt.datetime(2024, 1, 1)
    df = spark.range(14_400).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("observed_at"))
    bars = query.histogram(df, first, first + dt.timedelta(days=10), 60).collect()
    assert len(bars) == 14_401 and sum(r.n for r in bars) == 14_400


def test_addresses_have_one_spelling(spark):
    cases = {
        "2001:DB8:0:0:0:0:0:1": "2001:db8::1", "2001:db8::1": "2001:db8::1", "::ffff:0a00:0001": "10.0.0.1", "::FFFF:10.0.0.1": "10.0.0.1",
        " 10.0.0.1 ": "10.0.0.1", "::": "::", "::1": "::1", "fe80:0:0:0::": "fe80::", "1:0:0:2:0:0:0:3": "1:0:0:2::3", "1:0:0:2:3:0:0:4": "1::2:3:0:0:4",
        "64:ff9b::192.0.2.33": "64:ff9b::c000:221", "0001:002:03:4:5:6:7:8": "1:2:3:4:5:6:7:8", "1:0:2:3:4:5:6:7": "1:0:2:3:4:5:6:7",
        "nonsense:": "nonsense:", "1::2::3": "1::2::3", "12345::": "12345::", "host": "host",
    }
    got = frame(spark, [(a,) for a in cases], "a string").select("a", address_key("a").alias("k")).collect()
    assert {r.a: r.k for r in got} == cases


def test_ranges_that_are_refused_leave_the_others(spark):
    jobs = [("t", "j", "10.0.0.0/30"), ("t", "j", "nonsense"), ("t", "j", "10.0.0.0/8"), ("t", "k", "10.0.0.0/18")]
    df = frame(spark, jobs, "tenant_id string, job_id string, cidr string")
    got = addresses.range_expand(df, widest=16)
    assert {(r.cidr, r.problem) for r in got.where("problem is not null").collect()} == {("nonsense", "not a range"), ("10.0.0.0/8", "range too wide")}
    assert got.where("job_id = 'j' and problem is null").count() == 2
    assert got.where("job_id = 'k'").count() == 16_382


# --- identity ---


def test_a_batch_teaches_the_next(spark):
    known = frame(
        spark, [("t", "a", "hostname", "ha"), ("t", "a", "serial", "S0"), ("t", "b", "serial", "S1"), ("t", "b", "mgmt_ip", "2")],
        "tenant_id string, resource_id string, kind string, value string",
    )
    told = [
        ("o1", "hostname", "ha"), ("o1", "serial", "S0"), ("o1", "mac", "m1"),  # sure: its mac joins a
        ("o2", "serial", "S2"), ("o2", "mgmt_ip", "2"),  # other hardware at 2: both move
        ("o3", "hostname", "hc"), ("o4", "hostname", "hc"),  # nobody's, told twice
        ("o5", "hostname", "ha"), ("o5", "service_name", "s"),  # review: only the service is free
    ]
    observed = frame(spark, [("t", o, k, v) for o, k, v in told], "tenant_id string, observation_id string, kind string, value string")
    observations = observed.select("tenant_id", "observation_id").distinct().withColumn("source", F.lit("syslog"))
    observations = observations.unionByName(frame(spark, [("t", "o6", "syslog")], observations.schema))
    decisions = identity.identity_decide(observations, observed, known)
    targets = identity.identity_targets(observed, decisions)
    assert rows(targets, "observation_id", "why", "resource_id") == [
        ("o1", "merge", "a"), ("o2", "tier_one_contradiction", "new-o2"), ("o3", "no_match", "new-o3"),
        ("o4", "no_match", "new-o3"), ("o5", "review", "new-o5"), ("o6", "no_match", "new-o6"),
    ]
    changes = identity.identity_changes(observed, known, targets)
    assert rows(changes, "kind", "value", "resource_id", "previous_id", "change") == [
        ("hostname", "hc", "new-o3", None, "attached"), ("mac", "m1", "a", None, "attached"),
        ("mgmt_ip", "2", "new-o2", "b", "moved"), ("serial", "S2", "new-o2", None, "attached"),
        ("service_name", "s", "new-o5", None, "attached"),
    ]
    learnt = identity.identity_learn(known, changes)
    again = {r.observation_id: (r.outcome, r.resource_id) for r in identity.identity_decide(observations, observed, learnt).collect()}
    assert [again[o] for o in ("o1", "o2", "o3", "o4")] == [("match", "a"), ("match", "new-o2"), ("match", "new-o3"), ("match", "new-o3")]
    named = identity.identity_name_kind(observations, observed)
    assert [r[0] for r in rows(identity.identity_provisional(named, targets), "resource_id")] == ["new-o2", "new-o3", "new-o5", "new-o6"]
    groups = identity.identity_new_groups(observed, decisions)
    assert rows(identity.identity_targets(observed, decisions, groups).where("why = 'no_match'"), "observation_id", "resource_id") == [
        ("o3", "new-o3"), ("o4", "new-o3"), ("o6", "new-o6"),
    ]


def test_alias_chains(spark):
    schema = "tenant_id string, alias_id string, resource_id string"
    chain = frame(spark, [("t", "a", "b"), ("t", "b", "c"), ("t", "c", "d")], schema)
    assert rows(identity.alias_collapse(chain), "alias_id", "resource_id") == [("a", "d"), ("b", "d"), ("c", "d")]
    for bad in ([("t", "a", "a")], [("t", "a", "b"), ("t", "b", "a")]):
        with pytest.raises(ValueError):
            identity.alias_collapse(frame(spark, bad, schema))


def test_decisions(spark):
    known = frame(
        spark,
        [("t", "r1", "hostname", "a"), ("t", "r1", "mgmt_ip", "1"), ("t", "r1", "serial", "S1"), ("t", "r2", "hostname", "b"), ("t", "r2", "mac", "m")],
        "tenant_id string, resource_id string, kind string, value string",
    )
    offered = {
        "repeat": [("hostname", "a")], "clash": [("mgmt_ip", "1"), ("serial", "S2")], "merge": [("serial", "S1"), ("mac", "new")],
        "review": [("hostname", "a"), ("mac", "other")], "nothing": [], "stranger": [("hostname", "z")],
    }
    observed = frame(spark, [("t", o, k, v) for o, ids in offered.items() for k, v in ids], "tenant_id string, observation_id string, kind string, value string")
    observations = frame(spark, [("t", o, "syslog") for o in offered], "tenant_id string, observation_id string, source string")
    got = {r.observation_id: (r.outcome, r.reason, r.resource_id) for r in identity.identity_decide(observations, observed, known).collect()}
    assert got == {
        "repeat": ("match", None, "r1"), "clash": ("new", "tier_one_contradiction", None), "merge": ("merge", None, "r1"),
        "review": ("review", None, None), "nothing": ("new", "no_match", None), "stranger": ("new", "no_match", None),
    }
    shared = frame(spark, [("t", "o1", "mac", "1"), ("t", "o2", "mac", "1"), ("t", "o2", "serial", "x"), ("t", "o3", "serial", "x"), ("t", "o4", "mac", "9")], observed.schema)
    fresh = frame(spark, [("t", f"o{i}", "no_match") for i in range(1, 6)], "tenant_id string, observation_id string, reason string")
    groups = rows(identity.identity_new_groups(shared, fresh), "observation_id", "group_id")
    assert groups == [("o1", "new-o1"), ("o2", "new-o1"), ("o3", "new-o1"), ("o4", "new-o4"), ("o5", "new-o5")]


# --- network ---


def test_neighbours_match_a_walk(spark):
    rng = random.Random(2)
    data = []
    for n in range(300):
        protocol = rng.choice(["lldp", "cdp", "cdp", "arp"])
        data.append(
            (
                "t", f"d{n % 4}", protocol, n, rng.choice([None, "c1", "C1", "c2", "c3"]), rng.choice([None, "n1", "N1", "n2", "n3"]),
                rng.choice([None, f"10.0.0.{n}"]), rng.choice([None, f"m{n}"]),
            )
        )
    schema = "tenant_id string, seen_from string, protocol string, place long, chassis_id string, sys_name string, address string, platform string"
    got = rows(devices.neighbour_merge(frame(spark, data, schema)), "seen_from", "place", "address", "platform")
    low = lambda x: x and x.lower()
    want = []
    for device in sorted({d[1] for d in data}):
        mine = [list(d) for d in data if d[1] == device]
        stand = [d for d in mine if d[2] == "lldp"]
        for c in (d for d in mine if d[2] == "cdp"):
            for s in stand:
                by_chassis = s[4] and c[4]
                if low(s[4]) == low(c[4]) if by_chassis else (s[5] and low(s[5]) == low(c[5])):
                    s[6], s[7] = s[6] or c[6], s[7] or c[7]
                    break
            else:
                stand.append(c)
        stand += [d for d in mine if d[2] == "arp"]
        want += [(d[1], d[3], d[6], d[7]) for d in stand if d[6] or d[4]]
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_small_subnets(spark):
    subnets = frame(spark, [("t", "a", "10.0.0.0/24"), ("t", "b", "10.0.0.2/31"), ("t", "c", "10.0.0.9/32")], "tenant_id string, id string, cidr string")
    known = frame(spark, [("t", "r1", "mgmt_ip", "10.0.0.9"), ("t", "r2", "mgmt_ip", "fe80::1"), ("u", "r3", "mgmt_ip", "10.0.0.3")], "tenant_id string, resource_id string, kind string, value string")
    seen = frame(spark, [("t", "10.0.0.2"), ("t", "10.0.0.9"), ("t", "10.0.0.9")], "tenant_id string, address string")
    got = rows(addresses.subnet_utilisation(subnets, known, seen), "id", "capacity", "assigned", "responding", "unaccounted")
    assert got == [("a", 254, 1, 2, 1), ("b", 2, 0, 1, 1), ("c", 1, 1, 1, 0)]


# --- parsing ---


def test_syslog_lines(spark):
    got = {}
    lines = {
        "rfc": "<34>Oct 11 22:14:15 mymachine su: 'su root' failed for lonvick on /dev/pts/8",
        "pid": "<13>Oct  1 22:14:15 host sshd[1234]: Accepted password",
        "ahead": "<13>Dec 31 23:59:59 host app: late",
        "sd": '<165>1 2003-10-11T22:14:15.003Z m evntslog - ID47 [ex@1 a="x \\"q\\" \\] \\n" b="2"][two c="3"] ﻿An event',
        "open": '<165>1 2003-10-11T22:14:15Z m a - - [ex@1 a="x',
        "clock": "<165>1 yesterday m a - - - body",
        "none": "no priority", "zero": "<034>x", "big": "<192>x", "empty": "", "short": "<34>x",
    }
    df = frame(spark, [(k, v, dt.datetime(2026, 1, 1, 0, 5)) for k, v in lines.items()], "k string, line string, received_at timestamp")
    for r in syslog.parse_syslog(df).collect():
        got[r.k] = r
    assert (got["rfc"].facility, got["rfc"].severity, got["rfc"].hostname, got["rfc"].app_name) == (4, "critical", "mymachine", "su")
    assert got["rfc"].message == "'su root' failed for lonvick on /dev/pts/8" and got["rfc"].timestamp.year == 2025
    assert (got["pid"].proc_id, got["pid"].message) == ("1234", "Accepted password")
    assert got["ahead"].timestamp == dt.datetime(2025, 12, 31, 23, 59, 59)
    assert got["sd"].structured == {"ex@1.a": 'x "q" ] \\n', "ex@1.b": "2", "two.c": "3"}
    assert got["sd"].message == "An event" and got["sd"].parse_error is None
    assert got["open"].parse_error == "rfc5424: unterminated structured data" and got["open"].message.startswith("[ex@1")
    assert got["clock"].parse_error == "rfc5424: unreadable timestamp" and got["clock"].message == "body"
    assert {got[k].parse_error for k in ("none", "zero", "big")} == {"no priority"} and got["big"].message == "<192>x"
    assert got["empty"].parse_error == "empty message" and got["short"].parse_error == "rfc3164: too short for a timestamp"


def test_pairs_and_classes(spark):
    cases = {
        'a="x y" b=2 a=3 c="open to the end': {"a": "x y", "b": "2", "c": "open to the end"},
        "a=b=c =x y": {"a": "b=c"},
    }
    df = frame(spark, [(k,) for k in cases], "body string").select("body", security.key_values(F.col("body")).alias("m"))
    assert {r.body: r.m for r in df.collect()} == cases
    schema = "body string, service_name string, attributes map<string,string>"
    bodies = {
        "src=10.0.0.5 dst=203.0.113.9 dpt=445 proto=TCP act=deny": ("network", "denied", "Denied 10.0.0.5 → 203.0.113.9:445"),
        "user=bob result=ok action=denied": ("authentication", "success", "Succeeded for bob"),
        "src=1.1.1.1 dst=2.2.2.2 proto=TCP": None,
        "Started service=sshd": None,
        "CEF:0|A|B|1|7|SSL vpn login|3|suser=amy act=logon": ("vpn", "start", "SSL vpn login"),
    }
    df = frame(spark, [(b, "app", {"keep": "1"}) for b in bodies], schema)
    got = {r.body: r for r in security.security_events(df).collect()}
    for body, want in bodies.items():
        found = got.get(body)
        assert (found and (found.event_category, found.event_type, found.summary)) == want
    assert got[list(bodies)[0]].attributes["keep"] == "1" and got[list(bodies)[4]].attributes["observer.vendor"] == "A"


def test_sampling_probabilities(spark):
    cases = {"ot=p:2": 0.25, "ot=th:8": 0.5, "x=1,ot=rv:1;th:0": 1.0, "ot=p:99": 0.0, "": 0.0, "zz=p:1": 0.0}
    df = frame(spark, [(k,) for k in cases], "s string").select("s", otlp.sampling_probability(F.col("s")).alias("p"))
    assert {r.s: r.p for r in df.collect()} == cases


@pytest.mark.parametrize(
    ("kind", "groups", "scopes", "items", "read"),
    [
        ("logs", "resourceLogs", "scopeLogs", "logRecords", otlp.otlp_logs),
        ("metrics", "resourceMetrics", "scopeMetrics", "metrics", otlp.otlp_metrics),
        ("spans", "resourceSpans", "scopeSpans", "spans", otlp.otlp_spans),
    ],
)
def test_partly_unreadable_requests_are_told(spark, kind, groups, scopes, items, read):
    item = '{"name":"n","gauge":{"dataPoints":[{"timeUnixNano":"1704067200000000000","asDouble":1}]}}'
    good = f'{{"{scopes}":[{{"{items}":[{item}]}}]}}'
    scopeless, recordless = "a group without scopes", "a scope without records"
    bad = {
        f'{{"{scopes}":"oops"}}': scopeless, '{"instrumentationLibraryLogs":[{}]}': scopeless, f'{{"{scopes}":[5,{{}}]}}': scopeless,
        f'{{"{scopes}":[{{"{items}":"x"}}]}}': recordless, f'{{"{scopes}":[{{"{items}":[{item},"x"]}}]}}': recordless,
    }
    if kind == "metrics":
        bad[f'{{"{scopes}":[{{"{items}":[{{"sum":{{"dataPoints":[5]}}}}]}}]}}'] = "a metric without points"
    cases = {f'{{"{groups}":[{",".join(g)}]}}': (why, n) for b, why in bad.items() for g, n in (([b], 0), ([good, b], 1), ([b, good], 1))}
    cases |= {f'{{"{groups}":[{good}]}}': (None, 1), f'{{"{groups}":[]}}': (None, 0), f'{{"{groups}":["x",{good}]}}': ("no records", 0)}
    df = frame(spark, [(k, k, at(0)) for k in cases], "k string, payload string, received_at timestamp")
    assert {r.k: r.reason for r in otlp.unreadable(df, kind).collect()} == {k: why for k, (why, _) in cases.items() if why}
    assert {r.k: r["count"] for r in read(df).groupBy("k").count().collect()} == {k: n for k, (_, n) in cases.items() if n}


def test_nested_values_have_one_notation_at_any_depth(spark):
    def nested(depth):
        """A value of that many levels, alternately lists and attributes, and its flat form."""
        if depth == 0:
            return {"stringValue": 'a}"{[\\'}, 'a}"{[\\'
        value, flat = nested(depth - 1)
        if depth % 2:
            return {"arrayValue": {"values": [{"intValue": "1"}, value, None, {"doubleValue": 2.0}, {"arrayValue": {}}]}}, f"[1,{flat},,2,[]]"
        return {"kvlistValue": {"values": [{"key": "k", "value": value}, {"value": {"boolValue": True}}, {"key": "e"}]}}, f"{{k={flat},=true,e=}}"

    def request(value):
        pairs = [{"key": "v", "value": value}]
        record = {"body": value, "attributes": pairs, "timeUnixNano": "1"}
        return json.dumps({"resourceLogs": [{"resource": {"attributes": [{"key": "r", "value": value}]}, "scopeLogs": [{"logRecords": [record]}]}]})

    made = {d: nested(d) for d in (*range(8), 40)}
    df = frame(spark, [(d, request(v), at(0)) for d, (v, _) in made.items()], "d int, payload string, received_at timestamp")
    got = {r.d: (r.body, r.attributes["v"], r.attributes["r"]) for r in otlp.otlp_logs(df).collect()}
    assert got == {d: (flat,) * 3 for d, (_, flat) in made.items()}


# --- storage and tail ---


def test_stored_signal_prunes_days(spark, tmp_path):
    path = str(tmp_path / "metrics")
    df = frame(spark, [("t", f"r{i % 3}", "m", at(i * 40_000), at(i), float(i), {"l": "1"}) for i in range(9)], METRIC)
    signals.write_signal(df, "metrics", path)
    stored = signals.read_signal(spark, "metrics", path)
    page = query.scan(stored, "metrics", "t", start=at(0), end=at(86_400))
    assert page.count() == 3
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [" in plan
    assert stored.count() == 9 and "value" in stored.columns


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "metrics")
    df = frame(spark, [("t", f"r{i % 3}", "m", at(i * 40_000), at(i), float(i), {"l": "1"}) for i in range(9)], METRIC)
    signals.write_signal(df, "metrics", path, "0")
    signals.write_signal(df.limit(4), "metrics", path, "1")
    signals.write_signal(df, "metrics", path, "0")
    signals.write_signal(df, "metrics", path)
    stored = signals.read_signal(spark, "metrics", path)
    assert stored.count() == 22 and "batch" not in stored.columns


def test_absence_reads_the_days_of_its_window(spark, tmp_path):
    path = str(tmp_path / "metrics")
    signals.write_signal(frame(spark, [("t", "a", "m", at(i * 40_000), at(i), 1.0, {}) for i in range(9)], METRIC), "metrics", path)
    rules = frame(spark, [("t", "r", 3600)], "tenant_id string, rule_id string, after_seconds long")
    expected = frame(spark, [("t", "r", "a")], "tenant_id string, rule_id string, resource_id string")
    found = alerts.absence_values(signals.read_signal(spark, "metrics", path), rules, expected, F.lit(at(320_100)).cast("timestamp"))
    assert rows(found, "value", "breaching") == [(100.0, False)]
    assert "PartitionFilters: [isnotnull(event_date" in found._jdf.queryExecution().executedPlan().toString()


def test_polls_deliver_each_row_once(spark):
    data = [(i, at(i * 10 - (i % 5) * 300), at(i * 10)) for i in range(100)]
    df = frame(spark, data, "i long, observed_at timestamp, ingested_at timestamp")
    seen, since = [], at(0)
    for now in (at(300), at(301), at(900), at(1000)):
        page, since, skipped = poll(df, since, now)
        assert not skipped
        seen += [r.i for r in page.collect()]
    assert sorted(seen) == list(range(100))


# --- streams give what batches give ---


def test_streamed_incidents_match_batch(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    got, want = (rows(entry.queries()[n](spark, folder), "tenant_id", "event_id", "incident_id", "joined", "notify", "reason") for n in ("stream_incidents", "incident_group"))
    assert got == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["logs", "metrics", "spans"])
def test_a_request_is_read_once_for_its_faults_and_once_as_its_rows_are(spark, kind):
    df = frame(spark, [("a", None)], "k string, payload string")
    assert _plan(otlp.unreadable(df, kind)).count("from_json(") == 2


def test_faults_beside_malformed_attributes_are_told(spark):
    """What only the types of attributes bring to light is still told, and the first fault of those that need no types."""
    payload = lambda attributes, spans: f'{{"resourceSpans":[{{"resource":{{"attributes":{attributes}}},"scopeSpans":{spans}}}]}}'
    good = '[{"key":"a","value":{"stringValue":"b"}}]'
    cases = {"whole": payload(good, '[{"spans":[{}]}]'), "scopes": payload(good, '"oops"'), "both": payload('["x"]', '"oops"'), "number": payload(good, '[{"spans":[{"startTimeUnixNano":"x"}]}]')}
    found = {r.k: r.reason for r in otlp.unreadable(frame(spark, list(cases.items()), "k string, payload string"), "spans").collect()}
    assert found.pop("both") is not None
    assert found == {"scopes": "a group without scopes", "number": "a time that is no number"}


def test_overlapping_ranges_give_each_address_once_without_comparing_addresses(spark):
    cidrs = ["10.0.0.0/29", "10.0.0.0/31", "10.0.0.4/30", "10.0.0.0/29", "10.0.1.254/31", "10.0.0.0/22", "255.255.255.255/32", "0.0.0.0/32", "10.0.2.3/32", "10.0.4.0/31", "x"]
    rows = [(None, "j", c) for c in cidrs] + [("t", "j", "10.0.0.2/31"), ("t", None, "10.0.0.2/31")]
    for block in (4, 256, 1 << 12):
        got = addresses.range_expand(frame(spark, rows, "tenant_id string, job_id string, cidr string"), block=block)
        plan = _plan(got)
        assert 0 <= plan.index("Generate explode") < plan.index("Aggregate")  # what is distinct are ranges
        expected = [("t", "j", "10.0.0.2"), ("t", "j", "10.0.0.3"), ("t", None, "10.0.0.2"), ("t", None, "10.0.0.3")]
        for c in cidrs[:-1]:
            net = ipaddress.ip_network(c, strict=False)
            expected += [(None, "j", str(a)) for a in (net if net.prefixlen > 30 else list(net)[1:-1])]
        held = [(r.tenant_id, r.job_id, r.address) for r in got.where("problem IS NULL").collect()]
        key = lambda r: tuple(map(str, r))
        assert sorted(held, key=key) == sorted(set(expected), key=key)
    spread = addresses.range_expand(frame(spark, [("t", "j", "10.0.0.0/14")], "tenant_id string, job_id string, cidr string"))
    assert spread.select(F.spark_partition_id()).distinct().count() == 4  # as many as spark.sql.shuffle.partitions


def test_what_was_exploded_is_not_broadcast(spark):
    """Joins of stretches and of bucket rows are merges, whatever the size of the files they are made from."""
    from beaconry.llm import decontaminate, simhash

    text = " ".join(f"w{i}" for i in range(40))
    docs = frame(spark, [(1, text), (2, text + " and more"), (3, "other words")], "doc_id bigint, text string")
    found = decontaminate.contamination(docs, frame(spark, [("i", text)], "item_id string, text string"))
    assert [r.n_items for r in found.orderBy("doc_id").collect()] == [1, 1, 0]
    prints = simhash.fingerprints(docs).select(F.col("fp").alias("id"), "fp").distinct()
    plan = simhash.edges(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    plan = simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.lstrip().startswith("AdaptiveSparkPlan") and "SortMergeJoin [fp" in plan


def _streamed(spark, folder, parts, schema, transform):
    """What a stream writes of parts that arrive one after another, with a restart between them."""
    for data in parts:
        frame(spark, data, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = transform(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_streams_call_python_for_buckets_and_match_batch(spark, tmp_path, monkeypatch):
    """A record per key is kept over restarts, also of null keys; Python is called for buckets, not for keys."""
    rng = random.Random(5)
    data = [("t", f"k{rng.randrange(60)}" if i % 50 else None, i, at(i * 30), rng.random() < 0.6, rng.choice([0, 60])) for i in range(900)]
    schema = "tenant_id string, dedup_key string, evaluation_id long, at timestamp, breaching boolean, hold_seconds long"
    got = _streamed(spark, tmp_path / "alerts", [data[:400], data[400:]], schema, lambda s: stateful.stream_alerts(s, buckets=4))
    keys = {}
    for row in data:
        keys.setdefault(row[1], []).append(row)
    expected = {}
    for steps in keys.values():
        phase, since = "ok", None
        for _, _, n, when, breach, hold in steps:
            was, active = phase, phase in ("pending", "firing")
            if not breach:
                phase, since = ("resolved" if was == "firing" else "ok"), when
            elif was != "firing":
                start = since if active else when
                fires = (when - start).total_seconds() >= hold if active else hold <= 0
                phase, since = ("firing", when) if fires else ("pending", start)
            expected[n] = (phase, since, phase != was and phase in ("firing", "resolved"))
    assert {r.evaluation_id: (r.phase, r.since, r.notify) for r in got.collect()} == expected
    # Keys of a stream are its state's rows: no more than there are buckets.
    states = [("t", f"d{rng.randrange(80)}", at(i), i, rng.choice(["up", "down", "degraded"])) for i in range(900)]
    schema = "tenant_id string, resource_id string, observed_at timestamp, reading_id long, current_status string"
    known = frame(spark, [("t", f"d{i}", "up") for i in range(40)], "tenant_id string, id string, status string")
    got = _streamed(spark, tmp_path / "states", [states[:300], states[300:]], schema, lambda s: stateful.stream_transitions(s, known, buckets=4))
    last, changes = {f"d{i}": "up" for i in range(40)}, set()
    for _, name, _, n, status in states:
        was, last[name] = last.get(name, "unknown"), status
        if was != status and was not in stateful.HELD:
            changes.add((n, was, status))
    assert {(r.reading_id, r.previous_status, r.current_status) for r in got.collect()} == changes
    held = spark.read.format("statestore").load(str(tmp_path / "states" / "progress"))
    assert held.count() <= 4


def test_rows_of_a_tenant_are_merged_from_sorted_runs(monkeypatch):
    """A tenant's rows need not fit in memory: runs in files give the order of one sort, nulls last."""
    rng = random.Random(6)
    rows_ = [(None if i % 90 == 7 else pd.Timestamp(rng.randrange(50), unit="s"), rng.randrange(2), None if i % 70 == 3 else f"e{i}", [f"x{i}"] if i % 3 else None) for i in range(500)]
    whole = pd.DataFrame(rows_, columns=["at", "rank", "event_id", "near"])
    monkeypatch.setattr(stateful, "SORTED", 60)
    monkeypatch.setattr(stateful, "READ", 7)
    sizes, sort = [], stateful._in_order
    monkeypatch.setattr(stateful, "_in_order", lambda batches, order: sizes.append(len(f := sort(batches, order))) or f)
    batches = (whole.iloc[i : i + 30] for i in range(0, 500, 30))
    got = [(r.event_id, r.rank, None if r.near is None else list(r.near)) for r in stateful._merged(batches, ["at", "rank", "event_id"])]
    want = whole.sort_values(["at", "rank", "event_id"])
    assert got == [(e, r, n) for e, r, n in zip(want["event_id"].where(want["event_id"].notna(), None), want["rank"], want["near"])]
    assert max(sizes) <= 60
