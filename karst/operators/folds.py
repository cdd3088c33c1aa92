"""Folds along ordered rows: what depends on all rows before, by a rule that no window function expresses."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def folded(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: Sequence[str], start, step: Callable, out: str) -> DataFrame:
    """Adds the columns `out` (a DDL string) that step(state, *values) gives along each key's rows in order.

    step returns the next state and the new columns' values. Rows are sorted by key and pass as a stream, so a task holds
    one batch and one key's state, however many rows a key has. Null keys are keys.
    """
    added = T._parse_datatype_string(out).fields
    schema = T.StructType([*rows.schema.fields, *added])

    def run(batches):
        last, state = None, None
        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            new = []
            for key, *x in zip(own, *(batch.column(v).to_pylist() for v in values), strict=True):
                if key != last:
                    last, state = key, start
                state, got = step(state, *x)
                new.append(got)
            arrays = [pa.array([g[i] for g in new], to_arrow[i]) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *(f.name for f in added)])

    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    to_arrow = [kinds[f.dataType.simpleString()] for f in added]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fill(limit: int, overlap: int = 0) -> Callable:
    """A step that numbers groups of values (size, fresh) filled up to a limit: a value begins a group if it is fresh or
    doesn't fit. A group that follows one that was full begins with its last `overlap`, which counts too."""

    def step(state, size, fresh):
        number, held, carried = state
        if fresh or number < 0:
            number, held, carried = number + 1, size, 0
        elif held and carried + held + size > limit:
            number, held, carried = number + 1, size, min(overlap, held)
        else:
            held += size
        return (number, held, carried), (number,)

    return step


#: The state that fill() starts with.
EMPTY = (-1, 0, 0)
