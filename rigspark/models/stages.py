"""Fit/transform stages that produce and select plain input columns.

Each fit is one aggregate; the fitted numbers become literals, so transforms
are narrow projections inside whole-stage codegen. All stages are pure Python
ML stages with persisted parameters.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..functions.physics import add_features
from ..functions.rows import ratios
from ..operators.prepare import correlation_matrix, vif_keep
from ..params import BASE_FEATURES, PRODUCT_PAIRS, PROTECTED, RATIO_PAIRS, VIF_THRESHOLD


class _Fitted(Params):
    """Fitted numbers, kept as a JSON parameter so that they are saved with the stage."""

    state = Param(Params._dummy(), "state", "fitted values as JSON", typeConverter=TypeConverters.toString)

    def with_state(self, value):
        return self._set(state=json.dumps(value))

    def get_state(self):
        return json.loads(self.getOrDefault(self.state))


class _Stage(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    pass


class SetpointFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Derived time and stress inputs; the same stage serves measured and hypothetical rows."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return add_features(df)


class InteractionFeatures(Estimator, _Stage):
    """Mean-centred products (means of the fitted table) and plain ratios."""

    def _fit(self, df: DataFrame) -> InteractionModel:
        names = sorted({c for p in PRODUCT_PAIRS for c in p})
        m = df.agg(*[F.avg(c).alias(c) for c in names]).first()
        return InteractionModel().with_state({c: float(m[c]) for c in names})


class InteractionModel(Model, _Fitted, _Stage):
    def _transform(self, df: DataFrame) -> DataFrame:
        m = self.get_state()
        out = df.withColumns({
            f"{a}_x_{b}": (F.col(a) - F.lit(m[a])) * (F.col(b) - F.lit(m[b])) for a, b in PRODUCT_PAIRS})
        return ratios(out)


INTERACTIONS = tuple(f"{a}_x_{b}" for a, b in PRODUCT_PAIRS) + tuple(f"{a}_div_{b}" for a, b in RATIO_PAIRS)
ALL_FEATURES = BASE_FEATURES + INTERACTIONS


class PopulationScaler(Estimator, _Stage):
    """z-score with the population deviation; a column without variance keeps scale 1."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> AffineModel:
        cols = self.getInputCols()
        m = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return AffineModel(inputCols=cols, outputCols=self.getOutputCols()).with_state(
            [(float(m[f"m{i}"]), float(m[f"s{i}"]) or 1.0) for i in range(len(cols))])


class RangeScaler(Estimator, _Stage):
    """Min-max scaling to the fitted range; other tables may leave [0, 1]."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> AffineModel:
        cols = self.getInputCols()
        m = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("a", F.min), ("b", F.max))]).first()
        return AffineModel(inputCols=cols, outputCols=self.getOutputCols()).with_state(
            [(float(m[f"a{i}"]), float(m[f"b{i}"] - m[f"a{i}"]) or 1.0) for i in range(len(cols))])


class AffineModel(Model, _Fitted, _Stage):
    """(x - shift) / scale per column."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            o: (F.col(c) - F.lit(shift)) / F.lit(scale)
            for c, o, (shift, scale) in zip(self.getInputCols(), self.getOutputCols(), self.get_state())})


class VifSelector(Estimator, _Stage):
    """Keeps the inputs that survive collinearity pruning; one Spark job whatever the number of rounds."""

    threshold = Param(Params._dummy(), "threshold", "largest tolerated inflation", typeConverter=TypeConverters.toFloat)
    protected = Param(Params._dummy(), "protected", "columns never dropped", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, threshold=VIF_THRESHOLD, protected=None):
        super().__init__()
        self._setDefault(threshold=VIF_THRESHOLD, protected=list(PROTECTED))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> VifModel:
        cols = self.getInputCols()
        keep = vif_keep(correlation_matrix(df, cols), cols, self.getOrDefault(self.threshold), self.getOrDefault(self.protected))
        return VifModel(inputCols=cols).with_state(keep)


class VifModel(Model, _Fitted, _Stage):
    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def kept(self) -> list[str]:
        return self.get_state()

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*(set(self.getInputCols()) - set(self.kept)))


def with_all_features(df: DataFrame) -> DataFrame:
    return SetpointFeatures().transform(df)


def pick(cols: Iterable[str], df: DataFrame) -> list[str]:
    return [c for c in cols if c in df.columns]
