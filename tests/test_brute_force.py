"""Queries and operators that SQL can't express, against plain Python; sums and joins over more rows than one partition has."""

import math
from collections import OrderedDict, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom.operators import alerts, anomaly, dedup, promql, reliability, sinks
from logloom.operators.sequences import running_order
from logloom.plans import pipeline as pipe
from logloom.plans.adapters import events_as_log
from logloom.plans.queries import ORACLE, QUERIES
from logloom.sources import tail
from logloom.streaming import processors

US = 1_000_000


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_running_sums_over_many_partitions(spark, aqe):
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        n = 3_000_000
        rows = spark.range(n).select(((F.col("id") * 7919) % 3_000_017).alias("k"), F.lit("kept").alias("other"))
        out = running_order(rows, [], [F.col("k")], {"s": F.lit(1), "half": F.lit(0.5)})
        assert out.columns == ["k", "other", "s", "half"]
        found = out.agg(F.count("*"), F.count_distinct("s"), F.min("s"), F.max("s"), F.count_if(F.col("half") * 2 != F.col("s"))).first()
        assert tuple(found) == (n, n, 1, n, 0)
        next_one = out.select((F.col("s") - 1).alias("s"), F.col("k").alias("later"))
        assert out.join(next_one, "s").where("later <= k").isEmpty()
        kept = reliability.admitted(rows.withColumn("size", F.lit(2)), [], [F.col("k")], F.col("size"), 1_000_000)
        assert kept.where("admitted").count() == 500_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert running_order(rows.limit(0), [], [F.col("k")], {"s": F.lit(1)}).count() == 0


def test_cache_admission(spark, sf):
    e = events_as_log(spark, sf).select("id", "us", "source_id")
    for capacity, shards in ((64, 4), (5, 1)):
        shard = {r["id"]: r["s"] for r in e.select("id", F.pmod(F.xxhash64("source_id"), F.lit(shards)).alias("s")).collect()}
        caches, want = defaultdict(OrderedDict), {}
        for r in sorted(e.collect(), key=lambda r: (r["us"], r["source_id"])):
            cache = caches[shard[r["id"]]]
            want[r["id"]] = r["source_id"] in cache
            cache[r["source_id"]] = cache.pop(r["source_id"], None)
            while len(cache) > max(1, capacity // shards):
                cache.popitem(last=False)
        assert {r["id"]: r["cached"] for r in dedup.lru_admission(e, "source_id", "us", capacity, shards).collect()} == want
        assert len(set(want.values())) == 2


def _rules(samples, keys):
    """State and value of every rule, evaluated sample by sample."""
    rows = defaultdict(list)
    for s in samples:
        rows[s["metric"]].append(s)

    def windowed(metric, window, by):
        series = defaultdict(list)
        for s in rows[metric]:
            series[by(s)].append((s["us"], s["value"]))
        out = defaultdict(dict)
        for k, points in series.items():
            points.sort()
            for i, (t, _) in enumerate(points):
                out[k][t] = [p for p in points[: i + 1] if p[0] >= t - window * US]
        return out

    def increase(points):
        return sum(b if b < a else b - a for (_, a), (_, b) in zip(points, points[1:], strict=False))

    def slope(points):
        xs, ys = [(t - points[0][0]) / US for t, _ in points], [v for _, v in points]
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        var = sum((x - mx) ** 2 for x in xs)
        return sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / var if var else None

    def quantile(buckets, q):
        total = buckets[-1][1]
        if total <= 0:
            return None
        i = next(k for k, b in enumerate(buckets) if b[1] >= total * q)
        if math.isinf(buckets[i][0]):
            return buckets[-2][0]
        low, below = buckets[i - 1] if i else (0.0 if buckets[i][0] > 0 else buckets[i][0], 0.0)
        part = buckets[i][1] - below
        return low + (buckets[i][0] - low) * ((total * q - below) / part if part else 0)

    key = lambda s: tuple(s[k] for k in keys)
    out = {}
    for r in alerts.RULES:
        values = {}
        if r.kind in ("value", "ratio"):
            values = {(key(s), s["us"]): s["value"] for s in rows[r.metric]}
            if r.kind == "ratio":
                other = {(key(s), s["us"]): s["value"] for s in rows[r.other]}
                values = {k: v / other[k] if other[k] else None for k, v in values.items() if k in other}
        elif r.kind == "sum":
            for s in rows[r.metric]:
                values[key(s), s["us"]] = values.get((key(s), s["us"]), 0) + s["value"]
        elif r.kind == "quantile":
            per_time = defaultdict(list)
            for k, points in windowed(r.metric, r.window, lambda s: (*key(s), s["le"])).items():
                for t, p in points.items():
                    per_time[k[:-1], t].append((k[-1], increase(p) / r.window))
            values = {k: quantile(sorted(b), r.q) for k, b in per_time.items()}
        else:
            of = lambda metric: {(k, t): p for k, points in windowed(metric, r.window, key).items() for t, p in points.items()}
            own = of(r.metric)
            if r.kind == "deriv":
                values = {k: slope(p) if len(p) > 1 else None for k, p in own.items()}
            elif r.kind == "rate_ratio":
                other = {k: increase(p) / r.window for k, p in of(r.other).items()}
                values = {k: increase(p) / r.window / other[k] if other[k] else None for k, p in own.items() if k in other}
            else:
                values = {k: increase(p) / (1 if r.kind == "increase" else r.window) for k, p in own.items()}
        since = {}
        for (k, t), v in sorted(values.items(), key=lambda x: x[0][1]):
            v = None if v is None else v * r.scale
            on = v is not None and {">": v > r.limit, "<": v < r.limit, "==": v == r.limit}[r.op]
            since[k] = since.get(k) if on and since.get(k) is not None else t if on else None
            out[r.name, k, t] = (v, "inactive" if not on else "firing" if t - since[k] >= r.hold * US else "pending")
    return out


def test_alert_rules(spark):
    import random

    rng = random.Random(8)
    names = sorted({r.metric for r in alerts.RULES} | {r.other for r in alerts.RULES if r.other})
    by_metric = {r.metric: r for r in alerts.RULES}
    samples = []
    for name in names:
        for instance in ("a", "b"):
            total, flat = 0.0, rng.random() < 0.5
            for i in range(60):
                t = (i * 60 + rng.randint(0, 1) * 30 * (name == "up")) * US
                rule = by_metric.get(name)
                if name.endswith("_total"):
                    total = 0.0 if rng.random() < 0.05 else total + (0 if flat and i > 20 else rng.randint(0, 3000))
                    value = total
                elif rule and rule.kind == "deriv" or name in ("go_goroutines", "process_resident_memory_bytes", "process_open_fds"):
                    value = float(rng.randint(0, 100) + i * 700)
                else:
                    value = float(rng.choice([0, 1, 60, 90, 100]))
                if rule and rule.kind == "quantile":
                    samples += [(name, instance, b, t, float(i * k * rng.randint(1, 3))) for k, b in enumerate((1.0, 5.0, 25.0, math.inf), 1)]
                else:
                    samples.append((name, instance, None, t, value))
    frame = spark.createDataFrame(samples, "metric string, instance string, le double, us long, value double")
    got = {(r["alert"], (r["instance"],), r["us"]): (r["value"], r["state"]) for r in alerts.evaluate_all(frame, ["instance"]).collect()}
    want = _rules(frame.collect(), ["instance"])
    assert set(got) == set(want) and len({s for _, s in want.values()}) == 3
    for k, (v, state) in want.items():
        assert got[k][1] == state, (k, v, got[k])
        assert (got[k][0] is None) == (v is None) and (v is None or math.isclose(got[k][0], v, rel_tol=1e-6, abs_tol=1e-6)), (k, v, got[k])
    one = alerts.evaluate(frame, alerts.RULES[0], ["instance"])
    assert {(r["alert"], (r["instance"],), r["us"]): (r["value"], r["state"]) for r in one.collect()} == {k: x for k, x in got.items() if k[0] == alerts.RULES[0].name}


def test_rules_share_scans(spark):
    """The plan of all rules has one scan for each kind of window, whatever the number of rules."""
    frame = spark.range(10).select(F.lit("up").alias("metric"), F.lit("a").alias("instance"), F.lit(None).cast("double").alias("le"), F.col("id").alias("us"), F.lit(1.0).alias("value"))
    plan = alerts.evaluate_all(frame, ["instance"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 10") <= 3


def test_growth_with_ties_and_resets(spark):
    rows = [("a", 0, 5.0), ("a", 10 * US, 7.0), ("a", 10 * US, 9.0), ("a", 20 * US, 2.0), ("b", 0, 1.0), ("a", 31 * US, 4.0), ("a", 100 * US, None)]
    out = promql.with_increase(spark.createDataFrame(rows[:-1], "k string, us long, value double"), ["k"], "us", "value", 20)
    assert sorted((r["k"], r["us"] // US, r["increase"]) for r in out.collect() if r["us"] != 10 * US) == [("a", 0, 0.0), ("a", 20, 6.0), ("a", 31, 2.0), ("b", 0, 0.0)]
    sloped = promql.with_deriv(spark.createDataFrame(rows, "k string, us long, value double"), ["k"], "us", "value", 12)
    assert {r["us"] // US: r["deriv"] for r in sloped.collect() if r["us"] >= 20 * US} == {20: pytest.approx(-0.6), 31: pytest.approx(2 / 11), 100: None}


def test_rate_between_samples_of_one_time(spark, sf, tmp_path):
    rows = [("a", 0, 1, 5.0), ("a", 0, 2, 5.0), ("a", 0, 3, 7.0), ("a", 4 * US, 5, 9.0), ("a", 4 * US, 4, 8.0), ("a", 90 * US, 6, 9.0), ("b", 0, 7, 1.0), ("b", 0, 8, None)]
    out = promql.with_irate(spark.createDataFrame(rows, "k string, us long, id long, value double"), ["k"], "us", "value", 60, ties=("id",))
    assert {r["id"]: repr(r["irate"]) for r in out.collect()} == {1: "None", 2: "nan", 3: "inf", 4: "0.25", 5: "inf", 6: "None", 7: "None", 8: "None"}
    duck = duckdb.connect()
    duck.execute(f"copy (select * replace (event_id + 1000 * k as event_id) from '{sf}/events.parquet', range(3) t(k) order by event_id) to '{tmp_path}/events.parquet' (format parquet)")
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = sorted(repr(abs(x)) if x is not None else "None" for (x,) in duck.execute(f"select irate from ({ORACLE['q03_irate']})").fetchall())
    got = QUERIES["q03_irate"](spark, str(tmp_path)).collect()
    assert sorted(repr(r["irate"]) for r in got) == want and want.count("inf") > 100 and want.count("nan") > 10
    finite = {r["id"] for r in got if r["irate"] is not None and math.isfinite(r["irate"])}
    assert finite and max(finite) < 1000


def test_stream_batches_hold_a_batch_at_most(spark):
    rows = spark.range(5000).select(F.timestamp_micros(F.col("id")).alias("timestamp"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"), F.create_map(F.lit("app"), F.lit("x")).alias("labels"))
    got = sinks.loki_streams(rows, batch=700).collect()
    assert sorted(len(r["values"]) for r in got) == [100, *[700] * 7]
    assert sorted(int(v[0]) for r in got for v in r["values"]) == [1000 * i for i in range(5000)]


def test_routed_pipelines_scan_once(spark):
    source = """
pipelines:
  - {name: one, steps: [{name: a, type: field_add, config: {fields: {x: '1'}}}, {name: r, type: field_remove, config: {fields: [gone]}}]}
  - {name: two, steps: [{name: a, type: field_add, condition: 'yes', config: {fields: {x: '2'}}}]}
source_mapping: {one: [alpha], two: [beta]}
"""
    pipelines, mapping = pipe.load(source)
    rows = spark.createDataFrame([("alpha", "m"), ("beta", "yes"), ("beta", "no"), ("other", "m")], "source_type string, message string").withColumns({"labels": F.create_map(F.lit("gone"), F.lit("g")), "timestamp": F.timestamp_micros(F.lit(0).cast("long"))})
    out = pipe.apply_routed(rows, pipelines, mapping)
    got = sorted((r["source_type"], r["message"], r["pipeline"], tuple(sorted(r["labels"].items()))) for r in out.collect())
    assert got == [("alpha", "m", "one", (("x", "1"),)), ("beta", "no", "two", (("gone", "g"),)), ("beta", "yes", "two", (("gone", "g"), ("x", "2")))]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_explanations(spark):
    rows = spark.createDataFrame([(1, {"pattern_error_pattern_score": 4.0, "text_message_length": 9.0}, 0.95), (2, {}, 0.1)], "id long, features map<string,double>, score double")
    got = {r["id"]: r for r in anomaly.verdict(rows, {"statistical": F.col("score")}, F.col("features")).collect()}
    assert got[1]["severity"] == "critical" and got[2]["severity"] == "none"
    assert got[1]["recommendations"] and got[1]["reason"] != got[2]["reason"]


def test_breaker_stream_equals_batch(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = spark.createDataFrame([(k, float(t), rng.random() < p) for k, p in (("a", 0.2), ("b", 0.6), ("c", 0.9)) for t in sorted(rng.sample(range(4000), 300))], "k string, s double, ok boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = processors.breaker_stream(stream, "k", "s", "ok").writeStream.format("memory").queryName("breakers").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql("select k, s, ok, allowed, state from breakers").collect())
    want = sorted(tuple(r) for r in reliability.circuit_breaker(rows, ["k"], "s", "ok").select("k", "s", "ok", "allowed", "state").collect())
    assert got == want and {x[4] for x in want} == {"open", "half_open", "closed"}


def test_tail_survives_rotation_and_cuts_long_files(tmp_path):
    f = tmp_path / "app.log"
    f.write_text("one\ntwo\n")
    r = tail._TailReader({"path": str(tmp_path), "piecebytes": "7"})
    read = lambda a, b: [x[0] for p in r.partitions(a, b) for x in r.read(p)]
    first = r.latestOffset()
    assert sorted(read(r.initialOffset(), first)) == ["one", "two"]
    with f.open("a") as g:
        g.write("three\n")
    f.rename(tmp_path / "app.log.1")
    f.write_text("four is a longer line\nfive\n\nsix\n")
    second = r.latestOffset()
    assert sorted(read(first, second)) == ["five", "four is a longer line", "six", "three"]
    assert read(second, r.latestOffset()) == []
    (tmp_path / "app.log.1").write_text("x\n")  # cut short and written anew
    assert read(second, r.latestOffset()) == ["x"]
