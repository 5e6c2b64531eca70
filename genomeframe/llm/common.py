"""Reading ``documents`` and helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def with_fields(schema: T.StructType, *fields: tuple[str, str]) -> T.StructType:
    """``schema`` with more fields; a field of the same name is replaced where it stands."""
    out = list(schema.fields)
    for name, kind in fields:
        field = T.StructField(name, T._parse_datatype_string(kind), True)
        at = [i for i, f in enumerate(out) if f.name.lower() == name.lower()]
        if at:
            out[at[0]] = field
        else:
            out.append(field)
    return T.StructType(out)


def replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns replaced (by name, letter case aside) or added at its end."""
    names = list(batch.schema.names)
    arrays = list(batch.columns)
    lowered = [n.lower() for n in names]
    for name, values in columns.items():
        if name.lower() in lowered:
            arrays[lowered.index(name.lower())] = values
            names[lowered.index(name.lower())] = name
        else:
            arrays.append(values)
            names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
