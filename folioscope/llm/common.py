"""Helpers shared by the training-data operators.

Conventions that every operator here follows:

* A null text counts as the empty text unless the operator's docstring says otherwise.
* Only the named input columns are read; other columns pass untouched and are ignored by the queries.  In
  stages that rewrite or choose rows the whole row travels as one struct; where an operator adds columns, one of
  the input's that has the name of an added column gets ``_in`` at its end.
* A repeated row is an ordinary row: it is returned as often as it came.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from folioscope.lineage import cut, discard  # noqa: F401  the operators' tables are cut there

#: The column that carries an input row through a stage.
ROW = "__row"


def bounded_batches(spark: SparkSession) -> None:
    """Texts differ in length a thousandfold: batches for Python are bounded in rows and bytes, unless the session has lower bounds."""
    for name, most in (("maxRecordsPerBatch", 512), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = (spark.conf.get(key, None) or "").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table of a few numbers each that may be broadcast; larger ones are joined in a shuffle.
SENT_ROWS = 500_000


def small(table: DataFrame) -> DataFrame:
    """``table`` (read from disk, a few numbers a row), to be broadcast if it has been counted and is small enough."""
    return F.broadcast(table) if table.limit(SENT_ROWS + 1).count() <= SENT_ROWS else table


def carried(df: DataFrame, **named: Column | str) -> DataFrame:
    """The rows of ``df`` as one struct, with the given columns beside it."""
    return df.select(F.struct("*").alias(ROW), *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in named.items()])


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo n: the fold of a row."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def slices(values: pa.Array, rows: int, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(start, number) of runs of values with at most ``rows`` of them and, but for single ones, ``size`` bytes: what Python works on at once is bounded."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield at, stop - at
        at = stop


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def beside(df: DataFrame, read: str, fields: list[pa.Field], start: Callable[[], Callable[[pa.Array], list[pa.Array]]], rows: int = 256, keep: bool = False) -> DataFrame:
    """``df`` (without the column ``read`` unless ``keep``), with the columns ``fields`` that start()(values of ``read``) gives for some rows at a time.

    Columns travel under numbers, so that no name of the input meets one of the outputs.
    """
    kept = [c for c in df.columns if keep or c != read]
    added = [f.name for f in fields]
    names = []
    for own in kept:
        c = own
        while c in added or c in names or (c != own and c in kept):
            c += "_in"
        names.append(c)
    slots = [f"c{i}" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for at, n in slices(batch.columns[-1], rows):
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(part.columns[-1])], names=[*slots, *added])

    source = df.select(*[quoted(c).alias(s) for c, s in zip(kept, slots)], quoted(read).alias("__read"))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(f.name, from_arrow_type(f.type)) for f in fields]])
    found = source.mapInArrow(run, schema)
    return found.select(*[F.col(s).alias(n) for s, n in zip(slots, names)], *added)
