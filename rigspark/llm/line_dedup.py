"""Line deduplication over levelled sorted runs of line hashes.

``LineRuns`` keeps, for every line key seen so far, one row (two 64-bit hashes, owner). The rows are stored in runs: tables bucketed
and sorted by the hashes. A batch of documents groups its own keys, merge-anti-joins them with every run in turn, and what is left
becomes a run of level 0. When a level holds ``fanout`` runs they are merged into one run of the next level, so a batch meets a
logarithmic number of runs. Buckets make the runs join in place: only the batch is shuffled, never the history. Their number grows with
the lines and is that of the writing tasks, so a run has one file per bucket and a bucket a bounded size.

Batches come in ascending ranges of ids, therefore the owner of a key is the smallest id that holds it. A line is kept if its
document owns the key; that test joins on (hash, id), a key that no frequent line makes hot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir
from .base import SPACES, ascii_lower, given_id, query, sort_id, store, table, text_key

HASHES = ["_h1", "_h2"]
BUCKET_LINES = 8_000_000


class LineRuns:
    """Levelled runs of line keys in the shared folder."""

    def __init__(self, spark, fanout: int = 2, buckets: int = 32):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[str]] = []
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.folder = f"{shared_dir(spark)}/{self.name}"
        self.made = 0

    def _write(self, keys: DataFrame, level: int) -> DataFrame:
        name, self.made = f"{self.name}_{self.made}", self.made + 1
        (keys.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", f"{self.folder}/{name}")
         .format("parquet").saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return self.spark.table(name)

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            names = self.levels[level]
            if len(names) >= self.fanout:
                merged = self.spark.table(names[0])
                for n in names[1:]:
                    merged = merged.unionAll(self.spark.table(n))
                self.levels[level] = []
                # one file per bucket: the merged run is dealt by its buckets before it is written
                self._write(merged.repartition(self.buckets, *HASHES), level + 1)

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch (hashes, ``_id``); returns its new keys with their owners.

        All ids of the batch must be larger than those of earlier batches.
        """
        self._compact()
        keys = lines.groupBy(*HASHES).agg(F.min("_id").alias("_owner"))
        for names in self.levels:
            for name in names:
                keys = keys.join(self.spark.table(name).select(*HASHES).hint("merge"), HASHES, "left_anti")
        return self._write(keys.repartition(self.buckets, *HASHES), 0)

    def close(self) -> None:
        """Forget the table names; the files stay in the shared folder."""
        for n in range(self.made):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{n}")


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """One row per line whose key is long enough: ``_id``, ``_text`` (tells rows of one id apart), ``_pos``, ``_h1``, ``_h2``."""
    rows = docs.select(sort_id(F.col(id_col), F.col(text_col)).alias("_id"), text_key(F.col(text_col)).alias("_text"),
                       F.posexplode(_lines(F.col(text_col))).alias("_pos", "_line"))
    rows = rows.withColumn("_line", F.btrim("_line", F.lit(SPACES)))
    rows = rows.filter(F.char_length("_line") >= min_chars).withColumn("_key", ascii_lower(F.col("_line")))
    return rows.select("_id", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(17), F.col("_key")).alias("_h2"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4,
               fanout: int = 2, buckets: int | None = None) -> DataFrame:
    """Keep each repeated line only in the document with the smallest id that holds it.

    Returns one row per input row: the id, ``n_lines``, ``n_dropped`` and ``kept_text``.

    * Null or empty text: one empty line, which is kept. A key shorter than ``min_chars`` code points is never repeated.
    * Rows that share an id are one document: a line of theirs stays in all of them if the id owns it.
    * Rows without an id come after all others and are told apart by their texts. Lines repeated inside the owner all stay.
    * An empty table gives an empty table. A document whose lines are all dropped keeps the empty text.
    """
    spark = docs.sparkSession
    ids = docs.select(sort_id(F.col(id_col), F.col(text_col)).alias("_id"))
    cuts = ids.agg(F.percentile_approx("_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    batch = F.lit(0)
    for i, c in enumerate(sorted(set(cuts or [])), 1):
        batch = F.when(F.col("_id") > F.lit(c), i).otherwise(batch)
    lines = store(line_hashes(docs, id_col, text_col, min_chars).withColumn("_batch", batch), by="_batch")

    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // BUCKET_LINES))
    runs, dropped = LineRuns(spark, fanout, buckets), None
    for i in range(len(set(cuts or [])) + 1):
        mine = lines.filter(F.col("_batch") == i)
        owned = runs.add(mine).withColumnRenamed("_owner", "_id")
        lost = mine.join(owned.hint("merge"), [*HASHES, "_id"], "left_anti").select("_id", "_text", "_pos")
        dropped = lost if dropped is None else dropped.unionAll(lost)
    runs.close()

    # 64 line numbers to a word: the list of a document stays short, and a line finds its bit at once
    words = (dropped.groupBy("_id", "_text", F.shiftright("_pos", 6).alias("_word"))
             .agg(F.expr("bit_or(shiftleft(1L, _pos & 63))").alias("_bits")))
    masks = words.groupBy("_id", "_text").agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_mask"), F.sum(F.bit_count("_bits")).alias("_n"))
    rows = docs.select(sort_id(F.col(id_col), F.col(text_col)).alias("_id"), text_key(F.col(text_col)).alias("_text"), F.col(text_col).alias("_given"))
    rows = rows.join(masks, ["_id", "_text"], "left").withColumn("_lines", _lines(F.col("_given")))

    def stays(line, i):
        word = F.coalesce(F.col("_mask")[F.shiftright(i, 6)], F.lit(0).cast("bigint"))
        return F.getbit(word, i.bitwiseAND(F.lit(63))) == 0

    kept = F.when(F.col("_mask").isNull(), F.coalesce("_given", F.lit(""))).otherwise(
        F.array_join(F.filter("_lines", stays), "\n"))
    return rows.select(given_id(F.col("_id")).alias(id_col), F.size("_lines").cast("bigint").alias("n_lines"),
                       F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept_text"))


@query("op1_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
o AS (SELECT line_key, min(doc_id) AS owner FROM k WHERE length(line_key) >= 10 GROUP BY line_key),
m AS (SELECT k.doc_id, k.i, k.line, coalesce(o.owner <> k.doc_id, false) AS lost FROM k LEFT JOIN o ON k.line_key = o.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op1_line_dedup(spark, sf):
    kept = line_dedup(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
