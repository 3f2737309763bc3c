"""Running sums in an order, with or without groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import materialize


def running_order(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """Running sums of ``sums`` (null counts as nothing) per ``keys``. Without keys the rows are sorted over all tasks, so that no task sees all of them:
    one range shuffle, in whose partitions the sums run from zero, is written once; each partition's totals (one row each) are added to those after it."""
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({k: F.sum(v).over(w) for k, v in sums.items()})
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = {k: isinstance(t, T.IntegralType) for k, t in zip(sums, (f.dataType for f in df.select(*sums.values()).schema), strict=True)}
    rows = df.withColumns({k: F.coalesce(v.cast("long" if whole[k] else "double"), F.lit(0)) for k, v in sums.items()})
    names = list(sums)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", `__part` int, `__row` long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, upto = TaskContext.get().partitionId(), 0, dict.fromkeys(names, 0)
        for b in batches:
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            for k in names:
                columns[k] = pc.add(pc.cumulative_sum(columns[k]), pa.scalar(upto[k], columns[k].type))
                upto[k] = columns[k][-1].as_py() if b.num_rows else upto[k]
            columns |= {"__part": pa.array([part] * b.num_rows, pa.int32()), "__row": pa.array(range(seen, seen + b.num_rows), pa.int64())}
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    local = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "running-sums")
    totals = local.groupBy("__part").agg(*(F.max_by(k, "__row").alias(f"__t_{k}") for k in sums))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = totals.select("__part", *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums))
    out = local.join(F.broadcast(base), "__part").withColumns({k: F.col(k) + F.col(f"__b_{k}") for k in sums})
    return out.drop("__part", "__row", *(f"__b_{k}" for k in sums))
