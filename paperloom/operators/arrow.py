"""Arrow passes over rows: one column in, one column out, small slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def type_of(text: str) -> T.DataType:
    return T._parse_datatype_string(text)


def map_columns(df: DataFrame, columns: list[str], f: Callable, outputs: dict[str, str], slice_rows: int = 64) -> DataFrame:
    """Add the columns of ``f(*values) -> tuple`` (the value itself for a single output), row by row within slices of a batch.

    An input column that an output replaces is still read.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    new = {n.lower() for n in outputs}
    kept = [c for c in df.columns if c.lower() not in new]
    frame = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__in{k}") for k, c in enumerate(columns)])
    fields = [T.StructField(n, type_of(t)) for n, t in outputs.items()]
    kinds = [to_arrow_type(x.dataType) for x in fields]
    single = len(fields) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                given = [batch.column(f"__in{k}").to_pylist() for k in range(len(columns))]
                made = [f(*values) for values in zip(*given)]
                parts = [made] if single else list(zip(*made))
                arrays = [pa.array(p, type=k) for p, k in zip(parts, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + arrays, names=[*kept, *outputs])

    return frame.mapInArrow(run, T.StructType([df.schema[c] for c in kept] + fields))


def map_column(df: DataFrame, column: str, f: Callable, output: str, kind: str) -> DataFrame:
    return map_columns(df, [column], f, {output: kind})
