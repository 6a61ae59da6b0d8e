"""One pass over the ordered rows of each group, with a state that goes from row to row."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def scan(df: DataFrame, group: list[str], order: list[str], reads: list[str], start: Callable[[], Any], step: Callable[..., tuple[Any, tuple]], adds: str, *, descending: bool = False) -> DataFrame:
    """``df`` with the columns ``adds`` (a DDL list), worked out row by row.

    Groups are dealt to partitions and sorted there, ``order`` rising (nulls first) or falling; ``step``
    takes the state and the values of ``reads`` and gives the next state and the new values; a group
    begins with ``start()``. The state and one Arrow batch are all that is held, so a long group takes
    time in proportion to its rows and no more memory than a short one. Null keys are a group. Rows of
    equal order come in any order; name enough columns. Function and state must pickle by value.

    Groups are dealt by a struct of their keys: Spark drops a repartition by the keys themselves where a join
    or window before it deals by the same keys, and adaptive execution, which sees no need of that dealing in
    a map over batches, may then undo it (local reads, split partitions) and scatter a group over tasks.
    """
    new = StructType.fromDDL(adds)
    schema = StructType([*df.schema.fields, *new.fields])
    kinds = list(to_arrow_schema(new).types)
    at_key, at_read = ([df.columns.index(c) for c in cols] for cols in (group, reads))
    width = len(new.fields)

    def run(batches):
        key, state = object(), None
        for batch in batches:
            out: list[list] = [[] for _ in range(width)]
            keys = zip(*(batch.column(i).to_pylist() for i in at_key), strict=True)
            rows = zip(*(batch.column(i).to_pylist() for i in at_read), strict=True) if at_read else ((),) * batch.num_rows
            for k, row in zip(keys, rows, strict=True):
                if k != key:
                    key, state = k, start()
                state, values = step(state, *row)
                for held, x in zip(out, values, strict=True):
                    held.append(x)
            made = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *new.names])

    by = [F.col(f"`{c}`").desc_nulls_last() if descending else F.col(f"`{c}`").asc_nulls_first() for c in order]
    keys = [F.col(f"`{c}`") for c in group]
    return df.repartition(F.struct(*keys)).sortWithinPartitions(*keys, *by).mapInArrow(run, schema)
