"""Texts mapped by Arrow batches of few rows, and narrow sides of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task holds as Python objects at a time.
ROWS_AT_ONCE = 1000


def whole_text(column: str = "text") -> Column:
    """The text, null as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``; what its session sends to Python from now on goes in batches of at most ``ROWS_AT_ONCE`` rows.

    A batch of texts is held outside of the heap on the one side and by the worker on the
    other, by each task. A smaller number that the session has stays.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS_AT_ONCE:
        conf.set(name, str(ROWS_AT_ONCE))
    return docs


def map_texts(docs: DataFrame, keep: Sequence[str], schema: str, build: Callable[[], Callable[[list[str]], list]], text: Column | None = None) -> DataFrame:
    """Rows of ``docs``: the columns ``keep`` and those that the built function makes of the texts.

    ``schema`` is that of the added columns. ``build`` runs once in each task; what it
    returns takes a list of texts and gives a list of rows (tuples, one for each text). No
    shuffle, no state between rows: a lost task is simply run again. Other columns of
    ``docs`` are not read, whatever their names.
    """
    names = [x.strip().split()[0] for x in schema.split(",")]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    kinds = [types[x.strip().split()[1]] for x in schema.split(",")]
    kept = list(keep)
    narrow = small_batches(docs).select(*kept, (whole_text() if text is None else text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = build()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                rows = rows_of(part.column(len(kept)).to_pylist())
                made = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + made, names=kept + names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{fields}, {schema}" if fields else schema)


#: Rows of ids or fingerprints that are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def near(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow side of a join, sent to all tasks if it is counted to have at most ``most`` rows."""
    return F.broadcast(keys) if keys.count() <= most else keys
