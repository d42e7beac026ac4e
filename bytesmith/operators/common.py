"""One object in, rows out: the shape of most byte-level operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 4096


def per_object(objects: DataFrame, columns: list[str], make: Callable[..., Iterable[tuple]], ddl: str) -> DataFrame:
    """Rows of `ddl` from make(*values of columns) for each object, in Arrow batches and without a shuffle.

    The first column of ddl is object_id, which is put before each tuple."""
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for i in range(b.num_rows):
                key, *values = (b.column(c)[i].as_py() for c in range(b.num_columns))
                for row in make(*values):
                    rows.append((key, *row))
                    if len(rows) >= ROWS:
                        yield _batch(rows, arrow)
                        rows = []
        if rows:
            yield _batch(rows, arrow)

    return objects.select(F.col("object_id").cast("string").alias("object_id"), *columns).mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
