"""Sequential folds over the records of a key in order, in constant memory per key.

Rows are dealt by key and sorted by Spark (which spills); a task then streams through them and keeps one small state. What
follows from a whole history can't be split, but no key's rows are ever gathered. Rows that are equal in the order go by
their inputs, so the result doesn't depend on how they were dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TYPES = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable, step: Callable, out: dict[str, str]) -> DataFrame:
    """``df`` with the columns ``out``. ``start()`` makes a key's state; ``step(state, *inputs)`` gives (state, values)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{k}` {v}" for k, v in out.items())])
    columns = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, first = None, None, True
        for b in batches:
            at = b.schema.get_field_index
            found = zip(*(b.column(at(k)).to_pylist() for k in keys), strict=True) if keys else iter([()] * b.num_rows)
            given = zip(*(b.column(at(c)).to_pylist() for c in inputs), strict=True)
            rows = []
            for key, x in zip(found, given, strict=True):
                if first or key != current:
                    current, state, first = key, start(), False
                state, values = step(state, *x)
                rows.append(values)
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(out)
            yield pa.RecordBatch.from_arrays([*(b.column(at(c)) for c in columns), *(pa.array(c, _TYPES[t]) for c, t in zip(cols, out.values(), strict=True))], names=[*columns, *out])

    dealt = df.repartition(*keys) if keys else df.coalesce(1)
    return dealt.sortWithinPartitions(*dict.fromkeys([*keys, *order, *inputs])).mapInArrow(run, schema)
