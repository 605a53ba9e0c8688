"""Settings of a measurement campaign.

Every operator takes these as plain arguments; the dataclass only names the
defaults in one place so that a campaign can be described by one object.
"""

from __future__ import annotations

from dataclasses import dataclass

# Numbers a run archive of this kind is processed with.
DOWNSAMPLE_ROWS = 10
ROLLING_ROWS = 20
RUN_IN_ROWS = 60
WARM_UP_SECONDS = 35.0
STEADY_SECONDS = 300.0
END_OF_TEST_SECONDS = 7200.0
STEADY_AT_SECONDS = 7050.0
LOWER_BOUND = 0.001
HIGH_COF = 0.26
ERROR_LIMIT = 0.05
YOUNG_MODULUS_MPA = 210000.0
POISSON_RATIO = 0.3
BALL_RADIUS_MM = 5.0
RATIO_EPS = 1e-6
RANGE_EPS = 1e-9
SEED = 42
TEST_SHARE = 0.1
FOLDS = 5
TRIALS = 50
VIF_THRESHOLD = 5.0
# Most rows a background of attributions may have; it is an argument, never cut.
BACKGROUND_ROWS = 10_000
DOE_PICKS = 5
UNCERTAINTY_WEIGHT = 0.5
SPARSITY_WEIGHT = 0.5

# One (run, chunk) group never holds more rows than this: see scale.py.
CHUNK_ROWS = 1 << 20
# Largest table an operator broadcasts after counting it.
BROADCAST_ROWS = 200_000
# Groups above this size use the distributed exact quantile.
QUANTILE_ROWS = 100_000

TARGETS = ("cof", "fai")
SETPOINT = ("conc", "load_n", "temp_c", "ester")
BASE_FEATURES = (
    "time_s", "log_time", "time_squared", "load_n", "temp_c", "conc", "ester", "hertz_mpa",
)
# Inputs that collinearity pruning may never drop.
PROTECTED = ("load_n", "temp_c", "conc", "ester", "time_s", "log_time", "time_squared")
# Fixed values: (left, right) pairs of mean-centred products and of ratios.
PRODUCT_PAIRS = (
    ("load_n", "temp_c"), ("load_n", "conc"), ("temp_c", "conc"),
    ("ester", "temp_c"), ("ester", "load_n"), ("ester", "conc"),
)
RATIO_PAIRS = (("load_n", "temp_c"), ("conc", "load_n"), ("temp_c", "conc"))

# Setpoint grid axes: (first, step, number of levels).
GRID_AXES = {"conc": (0.0, 0.05, 13), "load_n": (10.0, 5.0, 39), "temp_c": (40.0, 5.0, 17)}


@dataclass(frozen=True)
class Params:
    """Signal-cleaning settings of one campaign."""

    downsample: int = DOWNSAMPLE_ROWS
    rolling: int = ROLLING_ROWS
    warm_up: float = WARM_UP_SECONDS
    steady_span: float = STEADY_SECONDS
    end_of_test: float = END_OF_TEST_SECONDS
    head_rows: int = 1
    tail_rows: int = 5
    chunk_rows: int = CHUNK_ROWS
