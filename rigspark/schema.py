"""Column contracts of raw and cleaned run tables, and the events adapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Headers of a run file and the column each one becomes.
ALIASES = {
    "Time": "time_s",
    "Load": "load_n",
    "Temperature": "temp_c",
    "Temperature 1": "temp_c",
    "COF": "cof",
    "Friction absolute integral": "fai",
    "Concentration": "conc",
    "Esterified": "ester",
}
NUMERIC = ("time_s", "load_n", "temp_c", "cof", "fai", "conc", "ester")
NOT_NULL = ("conc", "cof", "fai", "load_n", "temp_c")
NONZERO = ("temp_c", "load_n")
REQUIRED = ("conc", "ester")

# Report labels of the output columns.
LABELS = {
    "time_s": "Time [s]",
    "log_time": "Logarithmic time",
    "time_squared": "Squared time",
    "load_n": "Load [N]",
    "temp_c": "Temperature [°C]",
    "conc": "Concentration [wt%]",
    "ester": "Esterified [-]",
    "cof": "Coefficient of Friction (COF) [-]",
    "fai": "Friction Absolute Integral (FAI) [-]",
    "hertz_mpa": "Max. Hertzian Stress [MPa]",
    "weight": "Sample weight",
    "load_n_x_temp_c": "Load × Temperature",
    "load_n_x_conc": "Load × Concentration",
    "temp_c_x_conc": "Temperature × Concentration",
    "ester_x_temp_c": "Esterified × Temperature",
    "ester_x_load_n": "Esterified × Load",
    "ester_x_conc": "Esterified × Concentration",
    "load_n_div_temp_c": "Load / Temperature",
    "conc_div_load_n": "Concentration / Load",
    "temp_c_div_conc": "Temperature / Concentration",
}


def run_file_schema(temperature: str = "Temperature") -> T.StructType:
    """All-string layout of one run file: a units row and a footer share the columns."""
    names = ("Time", "Load", temperature, "COF", "Friction absolute integral", "Concentration", "Esterified")
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


CLEAN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("time_s", T.DoubleType()),
    T.StructField("load_n", T.DoubleType()),
    T.StructField("temp_c", T.DoubleType()),
    T.StructField("conc", T.DoubleType()),
    T.StructField("ester", T.IntegerType()),
    T.StructField("cof", T.DoubleType()),
    T.StructField("fai", T.DoubleType()),
    T.StructField("is_summary", T.BooleanType()),
])

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def measurements(events: DataFrame, decode_once: bool = False) -> DataFrame:
    """Shape an event log as a run archive: 40 runs, one signal sample per event.

    A pure projection, so column pruning and filters still reach the scan.
    ``seq`` is the sample's position key: unique, increasing with time.
    Filters on several derived columns would each repeat the text decoding
    when they are pushed below it; ``decode_once`` keeps them above.
    """
    e = (F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1)
         .when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    m = (F.col("user_id") % 8).cast("int")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    base = events.select(
        F.col("event_id").alias("seq"), us.alias("us"), "event_type", m.alias("m"), "value", e.alias("e"), k.alias("k"),
    )
    if decode_once:
        base = base.select(F.inline(F.array(F.struct(*base.columns))))
    return base.select(
        F.concat("event_type", F.lit("_"), F.col("m").cast("string")).alias("run_id"),
        "seq",
        ((F.col("us") - F.lit(1704067200000000)).cast("double") / F.lit(360e6)).alias("time_s"),
        (F.lit(20e0) + 25 * F.col("m") + (F.col("k") % 7 - 3) * F.lit(1e-1)).alias("load_n"),
        (F.lit(40e0) + 20 * F.col("e") + (F.col("k") % 5 - 2) * F.lit(1e-1)).alias("temp_c"),
        (F.lit(5e-2) * ((3 * F.col("e") + F.col("m")) % 13)).alias("conc"),
        ((F.col("e") + F.col("m")) % 2).alias("ester"),
        (F.lit(2e-2) + F.col("value") / F.lit(1000e0)).alias("cof"),
        (F.lit(5e-1) + F.lit(4e-3) * F.col("value") + F.col("k") / F.lit(100e0)).alias("fai"),
    )
