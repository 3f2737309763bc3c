"""The windowed algebra of metric queries over rows (keys, time in microseconds, value).

Windows are closed at both ends and not extrapolated: ``increase`` is the sum of the growth between samples inside the
window, where a fall is a reset to zero. Divisions by zero give null, but in ``with_irate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

US = 1_000_000


def selector(df: DataFrame, labels: str | None = None, equal: dict[str, str] | None = None, unequal: dict[str, str] | None = None, like: dict[str, str] | None = None, unlike: dict[str, str] | None = None) -> DataFrame:
    """Matchers on a map column or on columns; patterns match whole values, an absent label is ''."""

    def of(k: str) -> Column:
        return F.coalesce(F.col(labels)[k] if labels else F.col(k).cast("string"), F.lit(""))

    for k, v in (equal or {}).items():
        df = df.where(of(k) == v)
    for k, v in (unequal or {}).items():
        df = df.where(of(k) != v)
    for k, p in (like or {}).items():
        df = df.where(of(k).rlike(rf"\A(?:{p})\z"))
    for k, p in (unlike or {}).items():
        df = df.where(~of(k).rlike(rf"\A(?:{p})\z"))
    return df


def instant(df: DataFrame, keys: list[str], us: str, value: str, at_us: int, lookback_s: int = 300) -> DataFrame:
    """The last sample of each series at a moment, not older than the lookback."""
    return df.where((F.col(us) <= at_us) & (F.col(us) > at_us - lookback_s * US)).groupBy(*keys).agg(F.max_by(value, us).alias(value))


def with_window_start(df: DataFrame, keys: list[str], us: str, seconds: int | Column, values: dict[str, Column]) -> DataFrame:
    """``df`` with the ``values`` that the first sample inside each row's window has.

    Every row is asked for at its window's start among all samples, in one pass backwards through time that only remembers
    the last sample seen, instead of a frame that is added up again for every row. ``__n`` numbers the samples of a series.
    """
    width = F.lit(seconds * US) if isinstance(seconds, int) else seconds.cast("long") * US
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    sample = F.struct(F.col(us).alias("t"), F.lit(1).alias("is_sample"), F.col("__n").alias("n"), F.lit(None).cast(df.select(row).schema[0].dataType).alias("row"), F.struct(*(v.alias(k) for k, v in values.items())).alias("first"))
    asked = F.struct((F.col(us) - width).alias("t"), F.lit(0).alias("is_sample"), F.col("__n").alias("n"), row.alias("row"), F.lit(None).cast(df.select(F.struct(*(v.alias(k) for k, v in values.items()))).schema[0].dataType).alias("first"))
    events = df.select(*keys, F.explode(F.array(sample, asked)).alias("e")).select(*keys, "e.*")
    back = Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("is_sample"), F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("found", F.last("first", ignorenulls=True).over(back)).where("is_sample = 0")
    return found.select("row.*", *(F.col("found")[k].alias(k) for k in values))


def with_increase(df: DataFrame, keys: list[str], us: str, value: str, seconds: int | Column, out: str = "increase") -> DataFrame:
    """Growth between the samples in the window: the growth up to now less that up to the window's first sample."""
    by = Window.partitionBy(*keys).orderBy(us)
    prev = F.lag(value).over(by)
    grown = df.withColumns({"__d": F.when(prev.isNull(), 0.0).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev).cast("double"), "__n": F.row_number().over(by)})
    grown = grown.withColumns({"__upto": F.sum("__d").over(by), "__own": F.sum("__d").over(Window.partitionBy(*keys).orderBy(us, "__n").rowsBetween(Window.unboundedPreceding, 0))})
    found = with_window_start(grown, keys, us, seconds, {"__before": F.col("__own")})
    return found.withColumn(out, F.col("__upto") - F.col("__before")).drop("__d", "__n", "__upto", "__own", "__before")


def with_rate(df: DataFrame, keys: list[str], us: str, value: str, seconds: int | Column, out: str = "rate") -> DataFrame:
    return with_increase(df, keys, us, value, seconds, out).withColumn(out, F.col(out) / (float(seconds) if isinstance(seconds, int) else seconds.cast("double")))


def with_irate(df: DataFrame, keys: list[str], us: str, value: str, seconds: int, out: str = "irate", ties: tuple[str, ...] = ()) -> DataFrame:
    """Growth per second between the last two samples, if both lie in the window.

    Samples of one time follow each other by ``ties``; between them the division by zero is that of floating-point numbers:
    an infinite rate, NaN without growth.
    """
    by = Window.partitionBy(*keys).orderBy(us, *ties)
    prev, at = F.lag(value).over(by), F.lag(us).over(by)
    grown = F.when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev).cast("double")
    passed = F.col(us) - at
    at_once = F.when(grown == 0, float("nan")).otherwise(grown * float("inf"))
    return df.withColumn(out, F.when(passed == 0, at_once).when(passed <= seconds * US, F.try_divide(grown, passed / float(US))))


def with_deriv(df: DataFrame, keys: list[str], us: str, value: str, seconds: int | Column, out: str = "deriv") -> DataFrame:
    """Slope per second of the least-squares line through the window; null below two samples or where all have one time.

    From running sums of x, y, xx and xy up to now less those before the window's first sample. Times and values count from the
    series' first sample; the sums' loss of digits grows with the square of the series' length over the window's.
    """
    order = Window.partitionBy(*keys).orderBy(us)
    rows = df.withColumn("__n", F.row_number().over(order)).withColumns({"__x": ((F.col(us) - F.first(us).over(order)) / float(US)).cast("double"), "__y": (F.col(value) - F.first(value, ignorenulls=True).over(order)).cast("double")})
    terms = {"c": F.lit(1.0), "x": F.col("__x"), "y": F.col("__y"), "xx": F.col("__x") * F.col("__x"), "xy": F.col("__x") * F.col("__y")}
    terms = {k: F.when(F.col("__y").isNotNull(), v).otherwise(0.0) for k, v in terms.items()}
    upto = Window.partitionBy(*keys).orderBy(us, "__n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__t_{k}": v for k, v in terms.items()})
    rows = rows.withColumns({**{f"__u_{k}": F.sum(f"__t_{k}").over(order) for k in terms}, **{f"__o_{k}": F.sum(f"__t_{k}").over(upto) - F.col(f"__t_{k}") for k in terms}})
    found = with_window_start(rows, keys, us, seconds, {f"__b_{k}": F.col(f"__o_{k}") for k in terms})
    c, x, y, xx, xy = (F.col(f"__u_{k}") - F.col(f"__b_{k}") for k in terms)
    slope = F.when((c > 1) & (c * xx - x * x > 0), (c * xy - x * y) / (c * xx - x * x))
    return found.withColumn(out, slope).drop("__n", "__x", "__y", *(f"__{p}_{k}" for p in "tuob" for k in terms))


def histogram_quantile(buckets: DataFrame, keys: list[str], le: str, value: str, q: float, out: str = "quantile") -> DataFrame:
    """From cumulative buckets (one row with le = Infinity): linear inside a bucket; the last finite bound above them all."""
    row = F.struct(F.col(le).alias("le"), F.col(value).cast("double").alias("c"))
    g = buckets.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("b"))
    return g.select(*keys, quantile_of(F.col("b"), F.lit(q)).alias(out))


def quantile_of(b: Column, q: Column) -> Column:
    """The quantile of an array of buckets (le, c) in order; null without any count."""
    total = F.try_element_at(b, F.lit(-1))["c"]
    rank = total * q
    i = F.array_position(F.transform(b, lambda x: x["c"] >= rank), True).cast("int")
    hit, last = F.try_element_at(b, F.greatest(i, F.lit(1))), F.try_element_at(b, F.lit(-2))["le"]
    below = F.when(i > 1, F.try_element_at(b, i - 1)["c"]).otherwise(0.0)
    start = F.when(i > 1, F.try_element_at(b, i - 1)["le"]).otherwise(F.when(hit["le"] > 0, 0.0).otherwise(hit["le"]))
    inside = start + (hit["le"] - start) * F.coalesce(F.try_divide(rank - below, hit["c"] - below), F.lit(0.0))
    return F.when(total > 0, F.when(hit["le"] == float("inf"), last).otherwise(inside))


def sum_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias(value))


def avg_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(value))


def binary(a: DataFrame, b: DataFrame, on: list[str], op: str, value: str = "value") -> DataFrame:
    """One-to-one vector arithmetic on equal labels and times."""
    x, y = F.col(f"a.{value}"), F.col(f"b.{value}")
    result = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op]
    return a.alias("a").join(b.alias("b"), on).select(*on, result.alias(value))


def evaluate_at(df: DataFrame, keys: list[str], us: str, value: str, start_us: int, end_us: int, step_s: int, lookback_s: int = 300) -> DataFrame:
    """Range evaluation: at each step the last sample within the lookback.

    Each sample is dealt to the steps it can answer (at most lookback / step + 1), then the latest wins: no join.
    """
    step, look = step_s * US, lookback_s * US
    first = F.greatest(F.lit(start_us), F.lit(start_us) + F.ceil((F.col(us) - start_us) / step) * step)
    last = F.least(F.lit(end_us), F.lit(start_us) + F.floor((F.col(us) + look - 1 - start_us) / step) * step)
    dealt = df.withColumn("__f", first.cast("long")).withColumn("__l", last.cast("long")).where("__f <= __l").withColumn("step_us", F.explode(F.sequence("__f", "__l", F.lit(step))))
    return dealt.groupBy(*keys, "step_us").agg(F.max_by(value, us).alias(value))


def held(df: DataFrame, keys: list[str], us: str, condition: Column, hold_s: int | Column) -> DataFrame:
    """``state``: inactive, pending, or firing once the condition has held without a break for so long."""
    by = Window.partitionBy(*keys).orderBy(us)
    marked = df.withColumn("__c", F.coalesce(condition, F.lit(False)))
    started = marked.withColumn("__s", F.when(F.col("__c") & ~F.coalesce(F.lag("__c").over(by), F.lit(False)), F.col(us)))
    since = F.last("__s", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    active = started.withColumn("active_since_us", F.when(F.col("__c"), since))
    return active.withColumn("state", F.when(~F.col("__c"), "inactive").when(F.col(us) - F.col("active_since_us") >= (F.lit(hold_s * US) if isinstance(hold_s, int) else hold_s.cast("long") * US), "firing").otherwise("pending")).drop("__c", "__s")


def log_stream(df: DataFrame, labels: dict[str, str], start, end, ts: str = "timestamp", limit: int | None = None) -> DataFrame:
    """Records of a stream in a time range, newest first if limited."""
    out = selector(df, "labels", equal=labels).where((F.col(ts) >= start) & (F.col(ts) < end))
    return out.orderBy(F.desc(ts)).limit(limit) if limit else out
