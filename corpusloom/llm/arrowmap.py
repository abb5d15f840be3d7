"""mapInArrow with appended columns: each batch keeps its own columns, new ones replace any of the same name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def append(df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """df with the columns `fields`, which `make` computes for a whole batch (arrays in the order of the fields)."""
    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    at = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    names = [f.name for f in keep] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(i) for i in at] + [x if isinstance(x, pa.Array) else pa.array(x) for x in make(b)], names=names)

    return df.mapInArrow(run, T.StructType(keep + fields))


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
