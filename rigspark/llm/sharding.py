"""Sharding by proportional stratified interleaving.

Rows are shuffled inside their source by a seeded hash and ranked there. The fractional rank (rank + offset) / rows of the source
spreads every source evenly over 0 to 1; rows sorted by it are cut into shards of equal counts, so each shard holds every source in
its share of the whole.

No source is ranked in one task. The hash is uniform, so its leading digits cut a source into slices of bounded size that are already
in order: rows are numbered inside a slice, and slice counts give the numbers before it. Fractional ranks are uniform as well and
are numbered in the same way. The offset differs by source, so that many one-row sources do not all land on one rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .base import query, store, table

SLICE_ROWS = 16_384


def _fraction(hex_digest: Column) -> Column:
    """The first eight hex digits as a fraction of 2^32."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _numbered(rows: DataFrame, keys: list[str], slice_col: str, order: list[str], out: str, size: str) -> DataFrame:
    """0-based number of each row of ``keys`` by (slice, order), and the rows of ``keys``; a task sorts one slice of one key."""
    local = F.row_number().over(W.partitionBy(*keys, slice_col).orderBy(*order)) - 1
    counts = rows.groupBy(*keys, slice_col).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy(*keys).orderBy(slice_col)) - F.col("_rows")
    counts = counts.select(*keys, slice_col, before.alias("_before"), F.sum("_rows").over(W.partitionBy(*keys)).alias(size))
    placed = rows.withColumn("_local", local).join(counts, [*keys, slice_col])
    return placed.withColumn(out, F.col("_before") + F.col("_local")).drop("_before", "_local")


def interleaved_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", source_col: str = "source", carry: dict[str, Column] | None = None,
                       seed: int = 42, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Place every row in a shard: counts differ by one at most and every shard has the mixture of the whole.

    Returns the id, the columns of ``carry`` (name to expression over ``docs``), ``shard`` and ``slot`` (gapless from 0).

    * A null source is a source of its own. Sources with fewer rows than shards reach only some of them.
    * Repeated rows are placed one by one; ties in the hash go by id, and equal rows may swap places. A null id hashes as the empty text.
    * Fewer rows than shards: some shards stay empty. An empty table gives an empty table.
    """
    carry = carry or {}
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = store(docs.select(F.col(id_col).alias("_id"), source.alias("_source"), digest.alias("_digest"),
                           F.struct(F.lit(0).alias("_"), *[e.alias(n) for n, e in carry.items()]).alias("_carry")))
    total = rows.count()
    slices = max(1, -(-total // slice_rows))
    rows = rows.withColumn("_slice", F.floor(_fraction(F.col("_digest")) * slices))
    ranked = _numbered(rows, ["_source"], "_slice", ["_digest", "_id"], "_rank", "_size")
    share = (F.col("_rank") + _fraction(F.md5("_source"))) / F.col("_size")
    ranked = ranked.withColumn("_share", share).drop("_slice", "_rank", "_size")
    ranked = ranked.withColumn("_part", F.least(F.floor(F.col("_share") * slices), F.lit(slices - 1)))
    placed = _numbered(ranked, [], "_part", ["_share", "_digest", "_id", "_source"], "_at", "_all")
    shard = F.expr(f"cast(_at * {shards} as bigint) div cast({max(total, 1)} as bigint)")
    placed = placed.withColumn("_shard", shard)
    start = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return placed.select(F.col("_id").alias(id_col), *[F.col("_carry")[n].alias(n) for n in carry], F.col("_shard").cast("int").alias("shard"),
                         (F.col("_at") - start).cast("bigint").alias("slot"))


@query("op4_sharding", r"""
WITH RECURSIVE step(n, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, coalesce('=' || source, '') AS src, hex(encode(coalesce(text, ''))) AS hx, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
b AS (SELECT doc_id, src, digest, length(hx) // 2 + 1 AS size, list_transform(regexp_extract_all(hx, '..'),
  lambda x: CAST((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1 AS BIGINT)) AS bytes FROM d),
c AS (SELECT doc_id, src, digest, size, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes),
  lambda a, x: xor(a // 256, t[CAST(xor(a % 256, x) AS INT) + 1])), 4294967295) AS text_crc32 FROM b, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY digest, doc_id) - 1 AS rnk, count(*) OVER (PARTITION BY src) AS n,
  CAST(CAST('0x' || substr(md5(src), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (rnk + u) / n, digest, doc_id, src) - 1 AS spot, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(spot * 8 // total AS INT) AS shard, spot - ((spot * 8 // total) * total + 7) // 8 AS slot,
  CAST(NULL AS INT) AS grown_shard FROM p""")
def op4_sharding(spark, sf):
    text = F.coalesce("text", F.lit(""))
    out = interleaved_shards(table(spark, sf, "documents").select("doc_id", "source", "text"), 8, carry={
        "size": (F.octet_length(text) + 1).cast("bigint"), "text_crc32": F.crc32(F.encode(text, "UTF-8"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
