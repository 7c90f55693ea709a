"""Reading tables and small column helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import materialise

#: Rows that a table may have to be broadcast by hint; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back, so that lost executors cost a re-read."""
    return materialise(df, name)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a stored table of at most ``max_rows`` narrow rows; otherwise leave the
    join to Spark. Counting a stored table reads file footers only."""
    return F.broadcast(df) if df.count() <= max_rows else df


def add_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Append columns; an input column of the same name (in any case) is replaced."""
    taken = {c.lower() for c in columns}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken],
                     *[v.alias(k) for k, v in columns.items()])


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def over_batches(df: DataFrame, columns: list[str], schema: T.StructType,
                 rows: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """Map tuples of ``columns`` to tuples of ``schema`` in Arrow batches; ``rows`` sees one batch at a
    time, so its memory is bounded by a batch and what it yields is sent on every 2,000 rows."""
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields])

    def run(batches):
        for batch in batches:
            out = []
            for row in rows(zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                out.append(row)
                if len(out) == 2000:
                    yield _batch(out, arrow)
                    out = []
            if out:
                yield _batch(out, arrow)

    return df.select(*columns).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "binary": pa.binary(),
            "double": pa.float64(), "boolean": pa.bool_()}[kind.typeName()]
