"""What several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samphire.checkpoints import checkpoint_dir, cut_lineage
from samphire.shipping import ship

__all__ = ["checkpoint_dir", "cut_lineage", "fold", "hash_sample", "join_classes", "map_text", "segments", "slices", "text_chunks"]


SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; the fold rule of the train/held-out splits."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def text_chunks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first position, texts) in runs of about ``limit`` characters, whole texts only; null reads as empty."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        run.append(text or "")
        size += len(run[-1])
        if size >= limit:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run


def segments(text: str, limit: int = 1 << 22) -> Iterator[str]:
    """The whole text in parts of about ``limit`` characters, cut before single spaces between other characters.

    No token of the tokenizers here spans such a place, so very long texts can be encoded part by part.
    """
    start = 0
    while len(text) - start > limit:
        at = SINGLE_SPACE.search(text, start + limit)
        if at is None:
            break
        yield text[start : at.start()]
        start = at.start()
    yield text[start:]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Shorter batches: rows are whole documents, of which several copies are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_text(
    docs: DataFrame,
    carry: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
    text_col: str = "text",
) -> DataFrame:
    """Append ``fields``, computed from the text column, to the ``carry`` columns.

    ``make`` runs once for each task and gives the function from a batch's texts to one Arrow array a field.
    The text itself goes on only if it is in ``carry``.
    """
    ship(docs.sparkSession)
    wanted = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = T.StructType([*wanted.schema.fields[:-1], *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            made = work(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    return wanted.mapInArrow(run, schema)


def join_classes(rows: DataFrame, classes: DataFrame, key: str, hot: int = 100_000) -> DataFrame:
    """``rows`` with the columns of their class (key, __rows, ...); ``__rows``: how many rows the class has.

    Classes of ``hot`` rows or more are broadcast, so that none of them is one task's: there is at most one of them for
    each ``hot`` rows of the table. Null keys have no class.
    """
    big, small = (classes.where(F.col("__rows") >= hot), classes.where(F.col("__rows") < hot))
    held = big.drop("__rows")
    spread = rows.join(F.broadcast(held), key)  # at most one for each ``hot`` rows
    others = rows.join(F.broadcast(held.select(key)), key, "left_anti")
    return spread.unionByName(others.join(small.drop("__rows"), key))


def hash_sample(docs: DataFrame, text_col: str, rows: int) -> list[str]:
    """At most ``rows`` distinct whole texts, those of lowest hash: a bounded sample for fitting a model on the driver."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("__text")).where("__text IS NOT NULL")
    total = texts.count()
    span = 1 << 30
    key = F.pmod(F.xxhash64("__text"), F.lit(span))
    # twice the share that is wanted goes to the sort; all of a small table does
    near = texts.withColumn("__key", key).where(F.col("__key") < (span if total <= 4 * rows else span * 2 * rows // total))
    return [r["__text"] for r in near.distinct().orderBy("__key", "__text").limit(rows).collect()]
