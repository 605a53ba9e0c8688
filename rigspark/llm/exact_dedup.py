"""Exact deduplication by content-defined chunk recipes.

A text without white space is cut after boundary letters, so a cut depends on what stands there and not on where it stands. Chunks are
deduplicated: each distinct chunk moves once per map task, is grouped by its own content, and a hash that two different contents
share is found there. The identifier of a chunk is its 128-bit hash where that check shows it to be unique, and the hash with the chunk
itself where not. A document is then its ordered list of identifiers; equal lists mean equal texts, and only lists are compared and moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .base import LAST_ID, given_id, query, sort_id, store, table, text_key

BOUNDARY = "[qzxjkvwQZXJKVW]"
CHUNK = (512, 4096)


def without_spaces(c: Column) -> Column:
    """Delete every space, tab, line feed, vertical tab, form feed and carriage return."""
    out = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    for ch in "\t\x0b\f\r":
        out = F.when(F.contains(c, F.lit(ch)), F.replace(out, F.lit(ch), F.lit(""))).otherwise(out)
    return out


def chunks(c: Column, low: int = CHUNK[0], high: int = CHUNK[1]) -> Column:
    """Cut a text after boundary letters, at least ``low`` and at most ``high`` code points apart."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{{low},{high - 1}}}?{BOUNDARY}|.{{1,{high}}}"), F.lit(0))


STAYS = "_id = _keep AND _copy = 1"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """Group rows whose texts are identical without white space, and name the one that stays.

    Returns one row per input row: the id, ``keep_id``, ``group_size`` (rows of the group), ``kept``, ``text_sha256`` of the
    normalised text. Of a group, the row with the most code points stays, then the
    smallest id. ``hash_bits`` below 64 shortens the hashes to force collisions in tests.

    * Null counts as empty; all empty texts are one group. Rows without an id sort last.
    * A row repeated with its id and text: ``kept`` is true on one of them.
    * An empty table gives an empty table.
    """
    return _groups(docs, id_col, text_col, hash_bits).select(
        given_id(F.col("_id")).alias(id_col), given_id(F.col("_keep")).alias("keep_id"), F.col("_size").alias("group_size"),
        F.expr(STAYS).alias("kept"), F.col("_sha").alias("text_sha256"))


def _groups(docs: DataFrame, id_col: str, text_col: str, hash_bits: int = 64) -> DataFrame:
    mask = F.lit(-1 if hash_bits >= 64 else (1 << hash_bits) - 1).cast("bigint")

    def hashed(x: Column) -> Column:
        return F.struct(F.xxhash64(x).bitwiseAND(mask).alias("a"), F.xxhash64(F.lit(17), x).bitwiseAND(mask).alias("b"))

    plain = docs.select(sort_id(F.col(id_col), F.col(text_col)).alias("_id"), text_key(F.col(text_col)).alias("_text"),
                        F.char_length(F.coalesce(text_col, F.lit(""))).alias("_points"), without_spaces(F.col(text_col)).alias("_plain"))
    stored = store(plain.select("_id", "_text", "_points", F.sha2("_plain", 256).alias("_sha"), chunks(F.col("_plain")).alias("_chunks")))

    # distinct chunks by content, then the hashes that more than one of them has
    each = stored.select(F.explode("_chunks").alias("_chunk")).select(hashed(F.col("_chunk")).alias("_h"), "_chunk")
    distinct = each.groupBy(F.col("_h.a").alias("_a"), F.col("_h.b").alias("_b"), "_chunk").agg(F.lit(1).alias("_one"))
    shared = store(distinct.groupBy("_a", "_b").agg(F.count("_one").alias("_n")).filter("_n > 1").select("_a", "_b"))

    recipes = stored.select("_id", "_text", "_points", "_sha", F.transform("_chunks", hashed).alias("_recipe"))
    plainly = F.array_join(F.transform("_recipe", lambda h: F.concat(F.hex(h["a"]), F.lit("."), F.hex(h["b"]))), " ")
    if shared.isEmpty():
        recipes = recipes.select("_id", "_text", "_points", "_sha", plainly.alias("_recipe"))
    else:
        # an ambiguous hash is no identifier: documents that hold one name those chunks by their content
        parts = stored.select("_id", "_text", "_points", "_sha", F.posexplode_outer("_chunks").alias("_pos", "_chunk"))
        parts = parts.withColumn("_h", hashed(F.col("_chunk"))).withColumn("_a", F.col("_h.a")).withColumn("_b", F.col("_h.b"))
        parts = parts.join(shared.withColumn("_open", F.lit(True)), ["_a", "_b"], "left")
        name = F.concat(F.hex("_a"), F.lit("."), F.hex("_b"), F.when(F.col("_open"), F.concat(F.lit("."), F.hex("_chunk"))).otherwise(F.lit("")))
        # the chunk numbers of a document number its rows too: repeated rows are told apart below, by their count
        parts = parts.groupBy("_id", "_text", "_points", "_sha", "_pos").agg(F.min(name).alias("_name"), F.count(F.lit(1)).alias("_rows"))
        recipes = parts.groupBy("_id", "_text", "_points", "_sha").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_name"))), lambda x: x["_name"]), " ").alias("_recipe"),
            F.max("_rows").alias("_rows"))
        recipes = recipes.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows")))).drop("_row", "_rows")
    copy = F.row_number().over(W.partitionBy("_id", "_text").orderBy("_points"))
    recipes = store(recipes.withColumn("_copy", copy))

    # most code points, then the smallest id, as one number: sums and maxima of numbers need no sort
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    rank = (F.col("_points").cast("decimal(10,0)") * two64 + (F.lit(LAST_ID).cast("decimal(20,0)") - F.col("_id").cast("decimal(20,0)")))
    groups = store(recipes.groupBy("_recipe").agg(F.count(F.lit(1)).alias("_size"), F.max(rank.cast("decimal(38,0)")).alias("_best")))
    keep = (F.lit(LAST_ID).cast("decimal(20,0)") - F.pmod(F.col("_best"), two64)).cast("bigint")
    groups = groups.select("_recipe", "_size", keep.alias("_keep"))
    return recipes.join(groups, "_recipe").drop("_recipe", "_points")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; a row repeated with its id and text stays once."""
    kept = _groups(docs, id_col, text_col).filter(STAYS).select("_id", "_text")
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), sort_id(docs[id_col], docs[text_col]).alias("_id"), text_key(docs[text_col]).alias("_text"))
    first = F.row_number().over(W.partitionBy("_id", "_text").orderBy(F.lit(1)))
    rows = rows.join(kept, ["_id", "_text"], "left_semi").withColumn("_copy", first).filter("_copy = 1")
    return rows.select(*[F.col("_row")[c].alias(c) for c in names])


@query("op3_exact_dedup", r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
g AS (SELECT doc_id, plain, first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY plain) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g""")
def op3_exact_dedup(spark, sf):
    return exact_groups(table(spark, sf, "documents").select("doc_id", "text"))
