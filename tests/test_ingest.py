"""File sources, streaming ingest, stages and reports on files written here."""

import pytest
from pyspark.sql import functions as F

from rigspark.params import Params
from rigspark.plans.clean import clean_runs, quarantine
from rigspark.schema import run_file_schema
from rigspark.sources.report import write_report
from rigspark.sources.runs import archive_index, read_runs, trim_rows, union_all
from rigspark.sources.stage import stage
from rigspark.streaming.ingest import deliver, delivered, ingest_stream, read_clean

PARAMS = Params(downsample=4, rolling=3)


def write_run(folder, name, level, temperature="Temperature", n=60):
    lines = [f"Time,Load,{temperature},COF,Friction absolute integral,Concentration,Esterified", "s,N,C,-,-,wt%,-"]
    lines += [f"{20 + 10 * i},100,80,{level + 0.001 * (i % 7):.4f},{'N/A' if i == 9 else 1.5},0.3,1" for i in range(n)]
    lines += ["end,,,,,,"] * 5
    (folder / name).write_text("\n".join(lines) + "\n")


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.select(*cols).collect())


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "runs"
    d.mkdir()
    for i in range(3):
        write_run(d, f"run{i}.csv", 0.1 + 0.05 * i)
    return d


def test_text_rows_are_numbered_as_in_the_file(spark, folder):
    d = read_runs(spark, str(folder), "csv", run_file_schema())
    for i in range(3):
        mine = d.filter(F.col("run_id") == f"run{i}.csv").orderBy("seq").collect()
        assert [r["seq"] for r in mine] == list(range(66)) and mine[0]["Time"] == "s" and mine[1]["Time"] == "20" and mine[-1]["Time"] == "end"


def test_small_splits_keep_the_order(spark, folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        d = read_runs(spark, str(folder), "csv", run_file_schema()).filter("run_id = 'run1.csv'").orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["Time"] for r in d[1:61]] == [str(20 + 10 * i) for i in range(60)]


def test_layouts_with_other_headers_are_stacked(spark, tmp_path):
    for name, temp in (("a", "Temperature"), ("b", "Temperature 1")):
        (tmp_path / name).mkdir()
        write_run(tmp_path / name, f"{name}.csv", 0.1, temp)
    raw = union_all([read_runs(spark, str(tmp_path / "a"), "csv", run_file_schema()),
                     read_runs(spark, str(tmp_path / "b"), "csv", run_file_schema("Temperature 1"))])
    out = clean_runs(raw, PARAMS)
    assert {r["run_id"]: r["temp_c"] for r in out.groupBy("run_id").agg(F.avg("temp_c").alias("temp_c")).collect()} == {"a.csv": 80.0, "b.csv": 80.0}


def test_dropped_rows_are_in_quarantine(spark, folder):
    raw = read_runs(spark, str(folder), "csv", run_file_schema())
    lost = quarantine(raw, PARAMS)
    assert lost.filter("fai IS NULL").count() == 3 and lost.count() == 9  # two warm-up rows and one bad cell each


def test_two_drops_equal_one_batch(spark, folder, tmp_path):
    sink, check = str(tmp_path / "sink"), str(tmp_path / "check")
    go = lambda: ingest_stream(spark, str(folder), check, sink, run_file_schema(), params=PARAMS).awaitTermination()
    go()
    first = read_clean(spark, sink).select("run_id").distinct().count()
    for i in range(3, 5):
        write_run(folder, f"run{i}.csv", 0.1 + 0.05 * i)
    go()
    whole = clean_runs(read_runs(spark, str(folder), "csv", run_file_schema()), PARAMS)
    assert first == 3 and rows_of(read_clean(spark, sink)) == rows_of(whole)
    assert len(list((tmp_path / "sink").glob("batch_id=*"))) == 2
    again = tmp_path / "late"
    again.mkdir()
    write_run(again, "run1.csv", 0.3)
    clean_runs(read_runs(spark, str(again), "csv", run_file_schema()), PARAMS).write.parquet(f"{sink}/batch_id=2")
    newest = read_clean(spark, sink)
    assert newest.count() == whole.count() and newest.filter("run_id = 'run1.csv'").agg(F.min("cof")).first()[0] > 0.25


def test_stage_follows_its_inputs(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "stages")
    spark.range(10).withColumn("x", F.rand(1)).write.parquet(src)
    noisy = lambda: spark.read.parquet(src).withColumn("u", F.expr("uuid()"))
    a = rows_of(stage(noisy(), base, "v1"))
    assert rows_of(stage(noisy(), base, "v1")) == a
    assert rows_of(stage(noisy(), base, "v2")) != a
    spark.range(10, 20).withColumn("x", F.rand(2)).write.mode("append").parquet(src)
    assert len(rows_of(stage(noisy(), base, "v1"))) == 20


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_report_reads_back(spark, tmp_path, fmt):
    d = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "run_id string, cof double")
    paths = write_report({"t": d}, str(tmp_path), fmt, labels=fmt != "csv")
    back = spark.read.format(fmt).schema("run_id string, `Coefficient of Friction (COF) [-]` double" if fmt != "csv" else d.schema).load(paths["t"])
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1.5), ("b", 2.5)]


def test_run_spread_over_deliveries_is_cleaned_whole(spark, tmp_path):
    shape = lambda d: d.select("run_id", F.col("n").alias("seq"), *[c for c in d.columns if c not in ("run_id", "n")])
    whole = read_runs(spark, str(_runs(tmp_path / "all", 2)), "csv", run_file_schema())
    flat = whole.withColumnRenamed("seq", "n").select("run_id", "n", *[f"`{c}`" for c in whole.columns if c not in ("run_id", "seq")])
    for part in (0, 1):
        flat.filter(F.col("n") % 2 == part).withColumnRenamed("run_id", "run").write.mode("append").parquet(str(tmp_path / "in"))
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "sink"), schema, "parquet", PARAMS,
                      shape=lambda d: shape(d.withColumnRenamed("run", "run_id"))).awaitTermination()
    assert rows_of(read_clean(spark, str(tmp_path / "sink"))) == rows_of(clean_runs(whole, PARAMS))


def _runs(folder, n):
    folder.mkdir()
    for i in range(n):
        write_run(folder, f"run{i}.csv", 0.1 + 0.05 * i)
    return folder


def test_stage_tells_queries_apart(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "stages")
    spark.range(10).write.parquet(src)
    d = spark.read.parquet(src)
    assert sorted(r.id for r in stage(d.filter("id < 5"), base).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.id for r in stage(d.filter("id >= 5"), base).collect()) == [5, 6, 7, 8, 9]
    made = []
    for _ in range(2):
        assert stage(lambda: made.append(1) or d.limit(3), base, "three", origin=d).count() == 3
    assert made == [1]


def test_text_runs_are_parsed_once(spark, tmp_path):
    for run in "ab":
        (tmp_path / f"{run}.csv").write_text("x,y\n" + "".join(f"{i},{run}{i}\n" for i in range(30)))
    d = read_runs(spark, f"file://{tmp_path}", "csv", store=True)
    trimmed = trim_rows(d, 1, 5)
    assert "FileScan csv" not in trimmed._jdf.queryExecution().toString()
    rows = sorted((r["run_id"], r["seq"], r["y"]) for r in trimmed.collect())
    assert rows == [(f"{run}.csv", i, f"{run}{i}") for run in "ab" for i in range(1, 25)]
    base, made = f"file://{tmp_path}/stages", []
    for _ in range(2):  # the archive as read is an origin that stays the same
        stage(lambda: made.append(1) or d, base, origin=read_runs(spark, f"file://{tmp_path}/*.csv", "csv"))
    assert made == [1]


LAYOUTS = {
    "plain.csv": ["Time", "Load", "Temperature", "COF", "Friction absolute integral", "Concentration", "Esterified"],
    "turned.csv": ["Esterified", "Concentration", "Friction absolute integral", "COF", "Temperature", "Load", "Time"],
    "alias.csv": ["Load", "Temperature 1", "Time", "Note", "COF", "Friction absolute integral", "Esterified", "Concentration"],
    "lacking.csv": ["COF", "Time", "Load", "Temperature", "Friction absolute integral", "Concentration"],
    "deep/plain.csv": ["Load", "Time", "Temperature", "COF", "Friction absolute integral", "Concentration", "Esterified"],
    "odd + name é.csv": ["Time", "Load", "Temperature", "COF", "Friction absolute integral", "Concentration", "Esterified"],
}


def layouts(folder):
    """One archive of several layouts; returns the rows each file must give."""
    want = {}
    for k, (name, header) in enumerate(LAYOUTS.items()):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        rows = []
        for i in range(40):
            cells = {"Time": str(20 + 10 * i), "Load": str(100 + k), "Temperature": "80", "COF": f"0.1{i % 7}{k}", "Friction absolute integral": "1.5",
                     "Concentration": "0.3", "Esterified": "1", "Note": '"a, b"'}
            cells["Temperature 1"] = cells["Temperature"]
            rows.append(cells)
        path.write_text(("﻿" if k == 1 else "") + ",".join(header) + "\n" + "".join(",".join(r[h] for h in header) + "\n" for r in rows))
        want[name] = [tuple(r[c] if c in header or c == "Temperature" else None for c in LAYOUTS["plain.csv"]) for r in rows]
    return want


def cells_of(df):
    out = {}
    for r in df.orderBy("run_id", "seq").collect():
        out.setdefault(r["run_id"], []).append(tuple(r[c] for c in LAYOUTS["plain.csv"]))
        assert r["seq"] == len(out[r["run_id"]]) - 1
    return out


@pytest.mark.parametrize("store", [False, True])
def test_files_are_read_by_their_own_headers(spark, tmp_path, store):
    want = layouts(tmp_path)
    assert cells_of(read_runs(spark, str(tmp_path), "csv", run_file_schema(), store=store, recursiveFileLookup="true")) == want
    # one file at a time gives the same rows, under the file's own name
    for name in want:
        assert list(cells_of(read_runs(spark, str(tmp_path / name), "csv", run_file_schema())).values()) == [want[name]]


def test_small_splits_keep_header_and_order(spark, tmp_path):
    want = layouts(tmp_path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        assert cells_of(read_runs(spark, str(tmp_path), "csv", run_file_schema(), recursiveFileLookup="true")) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_names_of_all_files_without_a_schema(spark, tmp_path):
    layouts(tmp_path)
    d = read_runs(spark, str(tmp_path), "csv", recursiveFileLookup="true")
    assert set(d.columns) == {"run_id", "seq", "Note", *LAYOUTS["plain.csv"], "Temperature 1"}
    assert {r["Note"] for r in d.filter("run_id = 'alias.csv'").collect()} == {"a, b"}


def test_equal_names_of_several_folders_stay_apart(spark, tmp_path):
    layouts(tmp_path)
    d = read_runs(spark, [str(tmp_path / "plain.csv"), str(tmp_path / "deep")], "csv", run_file_schema())
    assert {r["run_id"] for r in d.select("run_id").distinct().collect()} == {"plain.csv", "deep/plain.csv"}
    assert read_runs(spark, str(tmp_path / "*.csv"), "csv", run_file_schema()).select("run_id").distinct().count() == 5


def test_unreadable_files_are_set_aside(spark, tmp_path):
    want = layouts(tmp_path)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "broken.csv").write_bytes(bytes(range(128, 256)) * 30 + b"\n" + bytes(range(1, 30)) * 20)
    (tmp_path / "cut.csv.gz").write_bytes(b"\x1f\x8b\x08\x00not a gzip stream")
    needed = ["Time", "COF", "Temperature"]
    d = read_runs(spark, str(tmp_path), "csv", run_file_schema(), needed=needed, recursiveFileLookup="true")
    assert cells_of(d) == want
    index = archive_index(spark, str(tmp_path), "csv", needed, ["Concentration", "Esterified"], recursiveFileLookup="true").collect()
    states = {r["run_id"]: (r["state"], r["missing"]) for r in index}
    assert len(index) == len(want) + 2 and states["plain.csv"] == ("read", []) and states["alias.csv"] == ("read", [])
    assert states["lacking.csv"] == ("read", ["Esterified"]) and "empty.csv" not in states and states["cut.csv.gz"][0] == "unreadable"
    assert states["broken.csv"] == ("set aside", [*needed, "Concentration", "Esterified"])
    with pytest.raises(Exception):
        read_runs(spark, str(tmp_path), "csv", run_file_schema(), recursiveFileLookup="true", ignoreCorruptFiles="false").count()


def test_truncated_parquet_is_set_aside(spark, tmp_path):
    for i in range(3):
        spark.range(50).selectExpr("id AS x", f"{i} AS y").coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        file = next((tmp_path / f"w{i}").glob("*.parquet"))
        data = file.read_bytes()
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"run{i}.parquet").write_bytes(data[:len(data) // 2] if i == 1 else data)
    d = read_runs(spark, str(tmp_path / "in"), "parquet")
    assert {(r["run_id"], r["count"]) for r in d.groupBy("run_id").count().collect()} == {("run0.parquet", 50), ("run2.parquet", 50)}
    index = archive_index(spark, str(tmp_path / "in"), "parquet").collect()
    assert {r["run_id"]: r["state"] for r in index} == {"run0.parquet": "read", "run1.parquet": "unreadable", "run2.parquet": "read"}


def test_a_delivery_reads_only_the_parts_it_touches(spark, tmp_path):
    sink, schema = str(tmp_path / "sink"), "run_id string, seq bigint, x int"
    for batch in range(6):
        deliver(spark.createDataFrame([(f"run{batch}", i, batch) for i in range(20)], schema), sink, batch, 64).count()
    again = deliver(spark.createDataFrame([("run3", i, 9) for i in range(20, 25)], schema), sink, 6, 64)
    assert again.count() == 25 and sum("-raw/" in f for f in again.inputFiles()) <= 3
    assert "PartitionFilters" in again._jdf.queryExecution().executedPlan().toString()
    repeated = deliver(spark.createDataFrame([("run3", i, 9) for i in range(20, 25)], schema), sink, 6, 64)
    assert repeated.count() == 25
    assert delivered(spark, sink, [r[0] for r in spark.createDataFrame([("run0",)], "r string").selectExpr("CAST(pmod(xxhash64(r), 64) AS INT)").collect()],
                     spark.read.parquet(f"{sink}-raw").schema).filter("run_id = 'run0'").count() == 20
