"""Reusable stage tables, valid for exactly the inputs they were built from."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def fingerprint(df: DataFrame, settings: object = None) -> str:
    """Hash of the plan, the input files (path, size, time of change), the output columns and the settings.

    The plan is what the query says, with running numbers taken out. Files are listed by Spark as a table and reduced there; contents are not read.
    """
    spark = df.sparkSession
    files = sorted(df.inputFiles())
    seen = ("", 0)
    if files:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files) \
            .select("path", "length", F.unix_micros("modificationTime").alias("t"))
        h = listing.select(F.xxhash64("path", "length", "t").alias("h")).agg(F.bit_xor("h").alias("x"), F.count(F.lit(1)).alias("n")).first()
        seen = (str(h["x"]), h["n"])
    text = json.dumps([_plan(df), seen, df.schema.simpleString(), str(settings)])
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def _plan(df: DataFrame) -> str:
    """The analysed plan as text: its nodes and expressions in full, without expression numbers and the seeds that the analysis draws."""
    spark = df.sparkSession
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.debug.maxToStringFields", "spark.sql.maxPlanStringLength")}
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return re.sub(r"#\d+L?|plan_id=\d+|(?<=Some\()-?\d+", "#", df._jdf.queryExecution().analyzed().toString())
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_stage(spark: SparkSession, path: str) -> DataFrame | None:
    """The stage table if its write was completed."""
    try:
        spark.read.text(f"{path}/done").first()
        return spark.read.parquet(f"{path}/rows")
    except AnalysisException:
        return None


def stage(df: DataFrame | Callable[[], DataFrame], path: str, settings: object = None, reuse: bool = True, origin: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once per state of its inputs, and read it from there.

    Where making ``df`` stores tables of its own, give a function that makes it, the ``origin`` it starts from, and all that
    shapes it in ``settings``: they decide, and the function is called only if nothing is stored for them.
    """
    known = origin if origin is not None else df
    spark = known.sparkSession
    target = f"{path}/{fingerprint(known, settings)}"
    found = read_stage(spark, target) if reuse else None
    if found is not None:
        return found
    df = df() if callable(df) else df
    df.write.mode("overwrite").parquet(f"{target}/rows")
    spark.createDataFrame([("done",)], "state string").write.mode("overwrite").text(f"{target}/done")
    return spark.read.parquet(f"{target}/rows")


class ModelStore:
    """Fitted models and what was found with them, in one folder per state of the inputs.

    The folder's name is the fingerprint of ``origin`` and the settings. A thing is there once its marker is: it is written last, so a
    broken run leaves nothing that counts. ``forget_others`` removes the folders of other states.
    """

    def __init__(self, origin: DataFrame, path: str, settings: object = None):
        self.spark, self.root, self.key = origin.sparkSession, path.rstrip("/"), fingerprint(origin, settings)
        self.folder = f"{self.root}/{self.key}"

    def notes(self, name: str) -> dict | None:
        """The notes that ``name`` was stored with, or None if it is not stored."""
        try:
            return json.loads(self.spark.read.text(f"{self.folder}/{name}/done").first()[0])
        except AnalysisException:
            return None

    def mark(self, name: str, notes: dict | None = None) -> None:
        self.spark.createDataFrame([(json.dumps(notes or {}),)], "notes string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{name}/done")

    def model(self, name: str, make: Callable[[], tuple[object, dict]], load: Callable[[SparkSession, str], object]) -> tuple[object, dict]:
        """A model with its notes: loaded if it is stored, else made, saved and marked. A model saves itself by ``save(path)``."""
        notes, path = self.notes(name), f"{self.folder}/{name}/model"
        if notes is not None:
            return load(self.spark, path), notes
        model, notes = make()
        model.save(path)
        self.mark(name, notes)
        return model, notes

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}/rows"
        if self.notes(name) is None:
            make().write.mode("overwrite").parquet(path)
            self.mark(name)
        return self.spark.read.parquet(path)

    def forget_others(self) -> list[str]:
        """Remove the folders of other states of the inputs; returns their names."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = []
        for status in files.listStatus(root) if files.exists(root) else []:
            name = status.getPath().getName()
            if status.isDirectory() and name != self.key and re.fullmatch("[0-9a-f]{24}", name):
                files.delete(status.getPath(), True)
                gone.append(name)
        return gone
