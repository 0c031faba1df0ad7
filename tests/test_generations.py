"""Compaction of rollups, repeats of stored batches, alert windows in panes, and malformed numbers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from beaconry.operators import alerts, rollups
from beaconry.session import matching, remove
from beaconry.sources import devices, otlp, signals
from beaconry.streaming.rollup import committed, compact, forget, read_partials, rollup_stream

T0 = dt.datetime(2026, 9, 1)
METRIC = "tenant_id string, resource_id string, metric string, observed_at timestamp, ingested_at timestamp, value double, labels map<string,string>"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def states(spark, path):
    return sorted(map(tuple, read_partials(spark, path, "metrics").select("resource_id", "bucket", "cnt", "sum_v").collect()))


def test_compaction_under_a_stream(spark, tmp_path):
    """Counts are the same before and after, late rows are added, and a crash before the commit changes nothing."""
    source, path, progress = (str(tmp_path / n) for n in ("source", "rollup", "progress"))

    def arrive(rows):
        spark.createDataFrame([("t", r, "m", at(s), at(s), float(s), {}) for r, s in rows], METRIC).write.mode("append").parquet(source)
        stream = spark.readStream.schema(METRIC).parquet(source)
        rollup_stream(stream, rollups.rollup_metrics_5m, path, progress).trigger(availableNow=True).start().awaitTermination()

    arrive([("a", 1), ("a", 2), ("b", 400)])
    assert committed(spark, path) == [] and not compact(spark, path, "metrics")  # the newest batch stays apart
    arrive([("a", 3), ("b", 90_000)])
    want = [("a", at(0), 3, 6.0), ("b", at(300), 1, 400.0), ("b", at(90_000), 1, 90_000.0)]
    assert states(spark, path) == want
    assert compact(spark, path, "metrics") and committed(spark, path) == [(1, 0)]
    assert states(spark, path) == want and not compact(spark, path, "metrics")
    # Late rows of a bucket that is compacted already.
    arrive([("a", 4)])
    want[0] = ("a", at(0), 4, 10.0)
    assert states(spark, path) == want
    # A generation that was written but not committed is not read, and is written over.
    spark.read.parquet(f"{path}/parts/batch_id=0").withColumn("event_date", F.to_date("bucket")).write.parquet(f"{path}/generations/generation=2")
    assert states(spark, path) == want
    assert compact(spark, path, "metrics") and committed(spark, path) == [(2, 1), (1, 0)] and states(spark, path) == want
    arrive([("c", 5)])
    assert compact(spark, path, "metrics", leave=0) and committed(spark, path)[0] == (3, 3)
    want.append(("c", at(0), 1, 5.0))
    assert states(spark, path) == want
    forget(spark, path)
    assert [g for g, _ in committed(spark, path)] == [3, 2] and states(spark, path) == want
    assert sorted(p[-1] for p in matching(spark, f"{path}/parts/batch_id=*")) == ["2", "3"]
    assert len(matching(spark, f"{path}/generations/*")) == 2
    arrive([("c", 6)])
    want[-1] = ("c", at(0), 2, 11.0)
    assert states(spark, path) == want
    remove(spark, f"{path}/nothing")


def test_a_corrected_batch_leaves_nothing_old(spark, tmp_path):
    path = str(tmp_path / "stored")
    write = lambda rows, batch: signals.write_signal(
        spark.createDataFrame([("t", "r", "m", at(s), at(s), float(v), {}) for s, v in rows], METRIC), "metrics", path, batch
    )
    read = lambda: sorted(r.value for r in signals.read_signal(spark, "metrics", path).collect())
    write([(0, 1), (90_000, 2)], "7")
    write([(0, 10)], "8")
    write([(90_000, 3)], "7")
    assert read() == [3, 10]
    write([(0, 4), (180_000, 5)], "7")
    assert read() == [4, 5, 10]
    with pytest.raises(ValueError, match="name"):
        write([(0, 1)], "a/b*")


@pytest.mark.parametrize("func", ["count", "sum", "min", "max", "avg", "count_distinct"])
def test_panes_are_whole_windows(spark, func):
    """Rules of many spans, some shorter than the least, beside each window taken alone; rows are aggregated before rules."""
    now, spans = at(100_000), [1, 60, 61, 119, 3600, 3601, 86_400]
    held = [("t" if i % 5 else "u", f"r{i % 3}", at(100_000 - (i * i) % 90_000 - 0.5 * (i % 2)), float(i % 7) if i % 11 else None, f"k{i % 2}") for i in range(700)]
    held += [("t", "r0", at(100_000 - s), 1.0, "k0") for s in spans] + [("t", "r0", at(100_000 - s) - dt.timedelta(microseconds=1), 2.0, "k0") for s in spans]
    held += [("t", "r0", now, 9.0, "k0")]
    rows = spark.createDataFrame(held, "tenant_id string, resource_id string, observed_at timestamp, value double, kind string")
    rules = [(t, f"{t}{s}", s) for t in "tu" for s in spans] + [("none", "x", 60)]
    df = alerts.threshold_values(
        rows, spark.createDataFrame(rules, "tenant_id string, rule_id string, span_seconds bigint"), F.lit(now).cast("timestamp"),
        func=func, field=None if func == "count" else "value", labels={"kind": F.col("kind")},
    )
    got = {(r.tenant_id, r.rule_id, r.resource_id, r.labels["kind"]): r.value for r in df.collect()}
    want = {}
    for tenant, rule, span in rules:
        begins = now - dt.timedelta(seconds=max(span, 60))
        for key in {(t, r, k) for t, r, _, _, k in held if t == tenant}:
            inside = [v for t, r, when, v, k in held if (t, r, k) == key and begins <= when < now]
            values = [v for v in inside if v is not None]
            if func == "count" and inside:
                found = len(inside)
            elif values and func != "count":
                found = {"sum": sum, "min": min, "max": max, "avg": lambda v: sum(v) / len(v), "count_distinct": lambda v: len(set(v))}[func](values)
            else:
                continue
            want[(tenant, rule, key[1], key[2])] = float(found)
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join Inner" in line and "_span" in line)
    assert any("Aggregate" in line and "_pane" in line for line in plan[join + 1 :])


def test_malformed_numbers_spoil_nothing_else(spark):
    good = {"timeUnixNano": "1788220800000000000", "startTimeUnixNano": "1788220800000000000", "asInt": "3", "name": "n"}
    make = {
        "logs": lambda r: {"resourceLogs": [{"scopeLogs": [{"logRecords": r}]}]},
        "spans": lambda r: {"resourceSpans": [{"scopeSpans": [{"spans": r}]}]},
        "metrics": lambda r: {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "gauge": {"dataPoints": r}}]}]}]},
    }
    readers = {"logs": otlp.otlp_logs, "spans": otlp.otlp_spans, "metrics": otlp.otlp_metrics}
    for kind, build in make.items():
        time = "startTimeUnixNano" if kind == "spans" else "timeUnixNano"
        cases = {"good": [good], "time": [good, good | {time: "1e9x"}], "value": [good, good | {"asInt": "oops"}], "none": [good, {time: good[time]}]}
        df = spark.createDataFrame([(k, json.dumps(build(r)), T0) for k, r in cases.items()], "k string, payload string, received_at timestamp")
        rows = {r.k: r["count"] for r in readers[kind](df).groupBy("k").count().collect()}
        told = {r.k: r.reason for r in otlp.unreadable(df, kind).collect()}
        if kind == "metrics":
            assert rows == dict.fromkeys(cases, 1) and told == {"time": "a time that is no number", "value": "a value that is no number"}
            assert otlp.otlp_metrics_unsupported(df).first()[0] == 3
        else:
            assert rows == {k: len(r) for k, r in cases.items()} and told == {"time": "a time that is no number"}
    readings = spark.createDataFrame([("t", "r", at(0), "1.2", v) for v in ("5", "oops")], "tenant_id string, resource_id string, observed_at timestamp, oid string, value string")
    asked = spark.createDataFrame([("m", "u", "1.2")], "metric string, unit string, oid string")
    assert devices.snmp_scalars(readings.where("value = 'oops'"), asked).first()["value"] is None
    assert devices.snmp_scalars(readings.where("value = '5'"), asked).first()["value"] == 5
