"""What the text operators share: the query registry, native string helpers, batch limits for Python tasks.

Rows are told apart by their id. Rows that share an id count as one document when documents are counted or compared; every row still
gets its own output row unless an operator says otherwise. Rows without an id are told apart by their texts and sort after all others.
Operators read the columns they name and build their output from fresh columns, so extra input columns of any name are harmless.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\f\r"
LAST_ID = 2**63 - 1
NULL_IDS = 2**40


def query(name: str, sql: str | None = None):
    """Register a query, with the equivalent SQL where there is one."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tasks_for(rows: int, each: int = 1 << 14) -> int:
    """Tasks that a table of so many narrow rows is worth: a task has its price, however few rows it gets."""
    return max(1, -(-rows // each))


def store(df: DataFrame, by: str | None = None, tasks: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: computed once, and safe from lost executors.

    ``by`` names a column whose values become folders, so that a later filter on it reads only those. ``tasks`` is for what a shuffle
    made of counted rows: the write takes no more tasks than these rows are worth, whatever the number of shuffle partitions.
    """
    path = f"{shared_dir(df.sparkSession)}/text-{uuid.uuid4().hex}"
    df = df if tasks is None else df.coalesce(tasks)
    (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sort_id(id_: Column, text: Column) -> Column:
    """The id as a number that is never null: a row without an id gets one by its text, after every given id."""
    own = F.lit(LAST_ID) - F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(NULL_IDS))
    return F.coalesce(id_.cast("bigint"), own)


def given_id(c: Column) -> Column:
    """Back from ``sort_id``."""
    return F.when(c <= F.lit(LAST_ID - NULL_IDS), c)


def by_id(docs: DataFrame, ids: DataFrame, how: str, id_col: str, text_col: str, most: int = 1_000_000) -> DataFrame:
    """Semi- or anti-join whole rows with a table of ``_id`` (as of ``sort_id``): broadcast if it is counted to be short, else shuffled."""
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), sort_id(docs[id_col], docs[text_col]).alias("_id"))
    small = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if small else ids, "_id", how).select(*[F.col("_row")[c].alias(c) for c in names])


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` is the quick way where the text is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def text_key(c: Column) -> Column:
    """A number that tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(c, F.lit("")), c.isNull())


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``. A null id hashes as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def bounded_batches(spark: SparkSession, mb: int = 8, rows: int = 4096) -> None:
    """Arrow batches for Python tasks end at so many bytes or rows, whichever comes first: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
