"""From raw run rows to the cleaned measurement table, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.physics import add_features
from ..functions.rows import default_flag, positive, valid_rows
from ..operators.stats import sample_weights
from ..operators.timeseries import downsample, rolling_mean, with_summary
from ..params import Params
from ..schema import CLEAN_SCHEMA
from ..session import cut
from ..sources.runs import coerce, trim_rows


def clean_runs(raw: DataFrame, params: Params = Params()) -> DataFrame:
    """Trim, coerce, filter, resample, smooth and summarise every run.

    Row positions are counted on the filtered rows, as the resampling needs
    them, so the filters stay below the first shuffle. The resampled signal, a
    tenth of the input, is stored once; the summary reads it several times.
    """
    d = trim_rows(raw, params.head_rows, params.tail_rows, rows=params.chunk_rows)
    d = valid_rows(coerce(d), min_time=params.warm_up)
    d = default_flag(downsample(d, params.downsample, rows=params.chunk_rows))
    d = cut(rolling_mean(d, "cof", params.rolling, dense=True, order="seq", rows=params.chunk_rows))
    d = with_summary(d, params.steady_span, params.end_of_test, rows=params.chunk_rows)
    d = positive(d)
    return d.select(*[F.col(f.name).cast(f.dataType) for f in CLEAN_SCHEMA.fields])


def quarantine(raw: DataFrame, params: Params = Params()) -> DataFrame:
    """Trimmed rows that cleaning drops, so nothing disappears unseen."""
    d = coerce(trim_rows(raw, params.head_rows, params.tail_rows, rows=params.chunk_rows))
    ok = valid_rows(d, min_time=params.warm_up).select("run_id", "seq")
    return d.join(ok, ["run_id", "seq"], "left_anti")


def feature_table(clean: DataFrame) -> DataFrame:
    """Cleaned rows with derived inputs and sample weights."""
    return sample_weights(add_features(clean))
