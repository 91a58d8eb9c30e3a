"""Functions that run over the rows of a task, return rows and leave a state.

Both come from one pass: a task's rows and its state are written together, so
the state is that of the attempt whose rows are kept, whatever tasks were
repeated, and neither is computed again when it is read.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallymark.session import materialise

#: Takes a task's Arrow batches, yields batches of rows and returns the task's state.
WorkerFunction = Callable[[Iterator[pa.RecordBatch]], Generator[pa.RecordBatch, None, dict[str, Any]]]


def map_with_state(df: DataFrame, function: WorkerFunction, rows: str, state: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the schema ``rows``, and one row of the schema ``state`` for every task.

    ``function`` must name the columns of ``rows`` in every batch that it
    yields; a field that its state lacks is null. A task without rows has a
    state too, so an empty table gives the function's first states.
    """
    row_type, state_type = T.StructType.fromDDL(rows), T.StructType.fromDDL(state)
    tagged = T.StructType([T.StructField("row", row_type), T.StructField("state", state_type)])
    schema = to_arrow_schema(tagged)
    row_arrow, state_arrow = schema.field("row").type, schema.field("state").type

    def run(batches):
        work = function(batches)
        while True:
            try:
                made = next(work)
            except StopIteration as end:
                last = pa.array([end.value or {}], state_arrow)
                break
            columns = [made.column(f.name).cast(f.type) for f in row_arrow]
            row = pa.StructArray.from_arrays(columns, fields=list(row_arrow))
            yield pa.RecordBatch.from_arrays([row, pa.nulls(len(row), state_arrow)], names=["row", "state"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, row_arrow), last], names=["row", "state"])

    stored = materialise(df.mapInArrow(run, tagged))
    return stored.where("row is not null").select("row.*"), stored.where("state is not null").select("state.*")
