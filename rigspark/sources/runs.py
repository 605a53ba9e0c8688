"""Reading run archives and shaping raw rows.

Text archives are read by their headers: every file says in its first line which column stands where. One archive may mix layouts
(other orders, other spellings, columns left out); each row takes its cells by the header of its own file, in one scan, however many
layouts there are. What a file's header says reaches its rows over the spine of (file, split), so no file is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..params import CHUNK_ROWS
from ..scale import CHUNK, attach, chunked, spine_all, spine_before, with_run_stats
from ..schema import ALIASES, NUMERIC, REQUIRED
from ..session import cut

#: Options of text files that say how a line is read; all others go to the scan.
LINE_OPTIONS = ("sep", "delimiter", "quote", "escape", "charToEscapeQuoteEscaping", "nullValue", "emptyValue", "ignoreLeadingWhiteSpace",
                "ignoreTrailingWhiteSpace")
MOST_COLUMNS = 20_000  # a first line with more cells is no header of a run


def run_name(spark: SparkSession, path: str | list[str]) -> Column:
    """The file of a row as a run id: its path below ``path`` (or below the common folder of several paths); a single file's own name.

    Files of one name in different folders are different runs.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    roots = []
    for p in [path] if isinstance(path, str) else path:
        parts = p.split("/")
        fixed = next((i for i, x in enumerate(parts) if any(c in x for c in "*?[{")), None)
        given = jvm.org.apache.hadoop.fs.Path(("/".join(parts[:fixed]) or "/") if fixed is not None else p)
        roots.append(given.getFileSystem(hadoop).makeQualified(given).toUri().getPath().rstrip("/").split("/"))
    shared = [level[0] for level in takewhile(lambda level: len(set(level)) == 1, zip(*roots))]
    root = "/".join(shared) + "/"
    # file paths come as encoded URIs; a plus sign stands for itself in them
    own = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    own = F.regexp_replace(own, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.when(F.startswith(own, F.lit(root)), F.substr(own, F.lit(len(root) + 1))).otherwise(F.regexp_extract(own, "([^/]*)$", 1))


def line_reader(reader, **options):
    """A reader of text lines (batch or stream) with those of the CSV ``options`` that concern the files."""
    scan = {k: v for k, v in options.items() if k not in (*LINE_OPTIONS, "header", "comment")}
    if str(scan.get("multiLine", "false")).lower() == "true":
        raise ValueError("run files have one row a line")
    return reader.format("text").options(**({"ignoreCorruptFiles": "true"} | scan))


def clean_lines(lines: DataFrame, **options) -> DataFrame:
    """Lines that hold a row or a header, without a byte order mark."""
    lines = lines.withColumn("value", F.ltrim("value", F.lit("\ufeff"))).filter(F.rlike("value", F.lit("[^\\x00-\\x20]")))
    return lines.filter(~F.startswith("value", F.lit(options["comment"]))) if options.get("comment") else lines


def read_lines(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Lines of text files that are not blank: ``run_id``, ``_start`` (of the split), ``_id`` (rises inside a split), ``value``.

    Files that cannot be read are passed over; ``archive_index`` lists them.
    """
    raw = line_reader(spark.read, **options).load(path)
    return clean_lines(raw.select(run_name(spark, path).alias("run_id"), F.col("_metadata.file_block_start").alias("_start"),
                                  F.monotonically_increasing_id().alias("_id"), "value"), **options)


def _line_options(options: Mapping[str, str]) -> dict[str, str]:
    return {k: str(v) for k, v in options.items() if k in LINE_OPTIONS}


def _cells(line: Column | str, width: int, options: Mapping[str, str], trim: bool = False) -> Column:
    """The cells of a line as an array of ``width`` strings, null beyond its last one."""
    parsed = F.from_csv(line, ", ".join(f"c{i} string" for i in range(width)), _line_options(options))
    return F.array(*[F.trim(parsed[f"c{i}"]) if trim else parsed[f"c{i}"] for i in range(width)])


def headers(lines: DataFrame, **options) -> tuple[DataFrame, int]:
    """The header index, one row per file (``run_id``, ``header``: column names in their order), and the largest number of columns."""
    sep = options.get("sep", options.get("delimiter", ","))
    first = lines.groupBy("run_id").agg(F.min_by("value", F.struct("_start", "_id")).alias("_line"))
    size = F.size(F.split("_line", "\\Q" + sep + "\\E"))
    width = first.agg(F.max(F.when(size <= MOST_COLUMNS, size))).first()[0] or 1
    return first.select("run_id", F.filter(_cells("_line", width, options, True), lambda c: c.isNotNull() & (c != "")).alias("header")), width


def same_meaning(name: str, aliases: Mapping[str, str] = ALIASES) -> list[str]:
    """Header names that fill the column ``name``, its own first."""
    return [name, *(h for h, means in aliases.items() if h != name and name in aliases and means == aliases[name])]


def rows_by_header(lines: DataFrame, schema: T.StructType | None = None, needed: Iterable[str] = (), aliases: Mapping[str, str] = ALIASES,
                   **options) -> DataFrame:
    """Lines -> rows with ``run_id``, ``seq`` (0 for the line below the header) and named columns.

    A column that a file lacks, under all its names, is null there. Files that lack one of ``needed`` give no rows. Cells that do not fit a
    column's type are null. Without a schema the columns are all names that occur, as strings, by the place they come first at. Of columns
    with one name in a file the first counts.
    """
    index, width = headers(lines, **options)
    if schema is None:
        found = index.select(F.posexplode("header").alias("_at", "name")).groupBy("name").agg(F.min("_at").alias("_at"))
        names = [r.name for r in found.orderBy("_at", "name").limit(MOST_COLUMNS + 1).collect()]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    d = lines.withColumn(CHUNK, F.col("_start"))
    d = d.withColumn("_local", F.row_number().over(W.partitionBy("run_id", CHUNK).orderBy("_id")))
    d = with_run_stats(
        d, "run_id", parts={"_rows": F.count(F.lit(1)), "_first": F.min_by("value", "_id")},
        whole={"_offset": F.coalesce(F.sum("_rows").over(spine_before("run_id")), F.lit(0)),
               "_top": F.first("_first").over(spine_all("run_id").orderBy(CHUNK).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))},
        keep_chunk=True)
    d = d.withColumn("seq", F.col("_local") + F.col("_offset") - 2).filter("seq >= 0")
    d = d.select("run_id", "seq", _cells("_top", width, options, True).alias("_names"), _cells("value", width, options).alias("_cells"))
    for name in needed:
        d = d.filter(reduce(lambda a, b: a | b, [F.array_contains("_names", n) for n in same_meaning(name, aliases)]))

    def cell(field: T.StructField) -> Column:
        at = F.lit(0)
        for n in reversed(same_meaning(field.name, aliases)):
            at = F.when(F.array_contains("_names", n), F.array_position("_names", n)).otherwise(at)
        value = F.get("_cells", at.cast("int") - 1)
        return (value if isinstance(field.dataType, T.StringType) else value.try_cast(field.dataType)).alias(field.name)
    return d.select("run_id", "seq", *[cell(f) for f in schema.fields])


def read_runs(spark: SparkSession, path: str | list[str], fmt: str = "csv", schema: T.StructType | None = None,
              store: bool = False, needed: Iterable[str] = (), **options) -> DataFrame:
    """Read run files; tag rows with the file's path below ``path`` and their place in it.

    Files that cannot be read are passed over (``archive_index`` lists them); ``ignoreCorruptFiles="false"`` makes them an error.
    CSV files are read by their own headers, see ``rows_by_header``. Parquet knows names and the row index; without a schema the columns of
    all files are put together. Other text formats are numbered by split: a split is read in order by one task, rows order by split
    start, then by generation order inside the split.
    ``store`` writes the lines of a text format once, so that whatever reads them several times does not read the files again. Leave
    it off for the ``origin`` of a stage: a stored table has a new name each time.
    """
    if fmt == "csv" and str(options.get("header", "true")).lower() == "true":
        lines = read_lines(spark, path, **options)
        return rows_by_header(cut(lines) if store else lines, schema, needed, **options)
    reader = spark.read.options(**({"ignoreCorruptFiles": "true"} | ({"mergeSchema": "true"} if fmt == "parquet" and schema is None else {}) | options))
    if schema is not None:
        reader = reader.schema(schema)
    raw = reader.format(fmt).load(path)
    names = [F.col(f"`{c}`") for c in raw.columns]
    file = run_name(spark, path).alias("run_id")
    if fmt == "parquet":
        return raw.select(file, F.col("_metadata.row_index").alias("seq"), *names)
    tagged = raw.select(file, F.col("_metadata.file_block_start").alias(CHUNK), F.monotonically_increasing_id().alias("_id"), *names)
    tagged = tagged.withColumn("_local", F.row_number().over(W.partitionBy("run_id", CHUNK).orderBy("_id")) - 1)
    placed = with_run_stats(tagged, "run_id", parts={"_rows": F.count(F.lit(1))},
                            whole={"_offset": F.coalesce(F.sum("_rows").over(spine_before("run_id")), F.lit(0))}, keep_chunk=True)
    placed = placed.select("run_id", (F.col("_local") + F.col("_offset")).alias("seq"), *names)
    return cut(placed) if store else placed


def archive_index(spark: SparkSession, path: str | list[str], fmt: str = "csv", needed: Iterable[str] = (), required: Iterable[str] = (),
                  aliases: Mapping[str, str] = ALIASES, **options) -> DataFrame:
    """One row per file below ``path``: ``run_id``, ``bytes``, ``header``, ``missing`` and ``state``.

    ``missing`` are the names of ``needed`` and ``required`` that no column of the file stands for; ``state`` is ``unreadable`` (listed, but
    the scan got nothing out of it), ``set aside`` (it lacks a ``needed`` column, so it gives no rows) or ``read``. Spark does not list
    files without a byte.
    The header of a format without header lines is null, and nothing is missing from it by name; ``audit`` judges it by its values.
    Files are listed by Spark and never opened for it; a file that breaks off after its first rows counts as read.
    """
    needed, required = list(needed), list(required)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", options.get("recursiveFileLookup", "false")).load(path)
    listed = listed.select(run_name(spark, path).alias("run_id"), F.col("length").alias("bytes"))
    if fmt == "csv":
        index, _ = headers(read_lines(spark, path, **options), **options)
    else:
        scan = spark.read.options(**({"ignoreCorruptFiles": "true"} | options)).format(fmt).load(path)
        index = scan.select(run_name(spark, path).alias("run_id")).distinct().withColumn("header", F.lit(None).cast("array<string>"))
    found = listed.join(index.withColumn("_seen", F.lit(True)), "run_id", "left")

    def lacking(names: list[str]) -> Column:
        known = F.array(*[F.when(~reduce(lambda a, b: a | b, [F.array_contains("header", n) for n in same_meaning(name, aliases)]), F.lit(name))
                          for name in names]) if names else F.array().cast("array<string>")
        return F.coalesce(F.array_compact(known), F.array().cast("array<string>"))
    state = (F.when(F.col("_seen").isNull(), "unreadable")
             .when(F.size(lacking(needed)) > 0, "set aside").otherwise("read"))
    return found.select("run_id", "bytes", "header", lacking(list(dict.fromkeys([*needed, *required]))).alias("missing"), state.alias("state"))


def trim_rows(df: DataFrame, head: int = 1, tail: int = 5, run: str = "run_id", seq: str = "seq",
              rows: int = CHUNK_ROWS) -> DataFrame:
    """Drop the first ``head`` and last ``tail`` rows of each run.

    Counting rows per chunk shows which chunks hold a run's ends; only those
    are ordered, to find the position keys to cut at. The rows themselves are
    filtered in place, without a shuffle.
    """
    ends = chunked(df.select(run, seq), seq, rows)
    spine = ends.groupBy(run, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    spine = spine.select(run, CHUNK, F.coalesce(F.sum("_n").over(spine_before(run)), F.lit(0)).alias("_before"),
                         "_n", F.sum("_n").over(spine_all(run)).alias("_total"))
    after = F.col("_total") - F.col("_before") - F.col("_n")
    ends = attach(ends, spine.filter((F.col("_before") < head) | (after < tail)), [run, CHUNK])
    pos = F.col("_before") + F.row_number().over(W.partitionBy(run, CHUNK).orderBy(seq)) - 1
    ends = ends.withColumn("_pos", pos)
    bounds = ends.groupBy(run).agg(F.max(F.when(F.col("_pos") < head, F.col(seq))).alias("_after"),
                                   F.min(F.when(F.col("_pos") >= F.col("_total") - tail, F.col(seq))).alias("_until"))
    d = attach(df, bounds, run, "left")
    keep = (F.col("_after").isNull() | (F.col(seq) > F.col("_after"))) & (F.col("_until").isNull() | (F.col(seq) < F.col("_until")))
    return d.filter(keep).select(*df.columns)


def coerce(df: DataFrame, aliases: Mapping[str, str] = ALIASES, numeric: Iterable[str] = NUMERIC) -> DataFrame:
    """Rename aliased columns and cast to double; unreadable or NaN cells become null.

    Cells are cast before aliases are put together, so an unreadable cell does not hide a good one.
    """
    out: dict[str, list] = {}
    numeric = set(numeric)
    for have in df.columns:
        name, c = aliases.get(have, have), F.col(f"`{have}`")
        if name in numeric:
            c = c.try_cast("double")
            c = F.when(~F.isnan(c), c)
        out.setdefault(name, []).append(c)
    return df.select(*[(F.coalesce(*cells) if len(cells) > 1 else cells[0]).alias(name) for name, cells in out.items()])


def audit(df: DataFrame, required: Iterable[str] = REQUIRED, run: str = "run_id") -> DataFrame:
    """Runs in which a required column is absent or wholly empty, with the list of such columns."""
    required = list(required)
    have = [c for c in required if c in df.columns]
    counts = df.groupBy(run).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"_{c}") for c in have])
    lacking = F.array_compact(F.array(*[
        F.when(F.col(f"_{c}") == 0, F.lit(c)) if c in have else F.lit(c) for c in required]))
    return (counts.withColumn("missing", lacking).filter(F.size("missing") > 0)
            .select(run, "n_rows", "missing"))


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
