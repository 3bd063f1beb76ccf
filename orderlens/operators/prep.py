"""Preprocessing estimators (fit on train, apply anywhere).

Each estimator computes its statistics in one aggregate, keeps them as
params (bounded by the number of features; persisted with the ML writer),
and transforms with literal column expressions — a narrow projection, no
join and no shuffle at apply time. They compose with MLlib stages in a
``pyspark.ml.Pipeline``.
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip, nan_inf_to_zero
from .profile import _quantiles
from .quantiles import code_rows, global_quantiles, order_number, quantile_ranks, values_at_ranks


class _ColsMixin(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    def _outs(self):
        ins = self.getInputCols()
        return self.getOrDefault(self.outputCols) if self.isDefined(self.outputCols) and \
            self.getOrDefault(self.outputCols) else ins

    def _copy_cols(self, model):
        model._set(inputCols=self.getInputCols(), outputCols=self._outs())
        return model


def _floats(vals):
    return [float("nan") if v is None else float(v) for v in vals]


# ---------------------------------------------------------------- median imputer
class MedianImputerModel(Model, _ColsMixin):
    medians = Param(Params._dummy(), "medians", "fitted medians", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        ms = self.getOrDefault(self.medians)
        return df.withColumns({o: (F.coalesce(F.col(i), F.lit(m)) if not math.isnan(m) else F.col(i))
                               for i, o, m in zip(self.getInputCols(), self._outs(), ms)})


class MedianImputer(Estimator, _ColsMixin):
    """Fill NULLs with the exact median (linear interpolation: 1.5 for 1, 2).
    ``accuracy`` switches to ``percentile_approx`` for continuous columns at scale."""
    accuracy = Param(Params._dummy(), "accuracy", "percentile_approx accuracy (0 = exact)", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, accuracy=0):
        super().__init__()
        self._setDefault(accuracy=0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        acc = self.getOrDefault(self.accuracy) or None
        cols = self.getInputCols()
        if acc is None:
            q = global_quantiles(df, cols, (0.5,))
            meds = [q[c][0] for c in cols]
        else:
            row = df.agg(*[_quantiles(c, (0.5,), acc)[0].alias(c) for c in cols]).first()
            meds = [row[c] for c in cols]
        return self._copy_cols(MedianImputerModel())._set(medians=_floats(meds))


# ---------------------------------------------------------------- mode imputer
class ModeImputerModel(Model, _ColsMixin):
    modes = Param(Params._dummy(), "modes", "fitted modes", TypeConverters.toListString)

    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({o: (F.coalesce(F.col(i), F.lit(m)) if m != "\0" else F.col(i))
                               for i, o, m in zip(self.getInputCols(), self._outs(), self.getOrDefault(self.modes))})


class ModeImputer(Estimator, _ColsMixin):
    """Fill NULLs with the most frequent value (smallest value on ties).
    One scan and one grouped count (partial aggregation) for all columns."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        cols = self.getInputCols()
        pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v"))
                                    for i, c in enumerate(cols)))).alias("p")
        u = df.select(pairs).select("p.*").filter(F.col("v").isNotNull()).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        # one job: per column the value with the highest count, smallest value on ties
        best = u.groupBy("i").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v")).collect()
        found = {r["i"]: r["v"] for r in best}
        modes = [found.get(i, "\0") for i in range(len(cols))]
        return self._copy_cols(ModeImputerModel())._set(modes=modes)


# ---------------------------------------------------------------- quantile clipper
class QuantileClipperModel(Model, _ColsMixin):
    lows = Param(Params._dummy(), "lows", "lower bounds", TypeConverters.toListFloat)
    highs = Param(Params._dummy(), "highs", "upper bounds", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for i, o, lo, hi in zip(self.getInputCols(), self._outs(), self.getOrDefault(self.lows),
                                self.getOrDefault(self.highs)):
            out[o] = clip(i, None if math.isnan(lo) else lo, None if math.isnan(hi) else hi)
        return df.withColumns(out)


class QuantileClipper(Estimator, _ColsMixin):
    """Fit per-column lower/upper quantiles (NULLs skipped), clip to them."""
    lower = Param(Params._dummy(), "lower", "lower quantile", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "upper quantile", TypeConverters.toFloat)
    accuracy = Param(Params._dummy(), "accuracy", "percentile_approx accuracy (0 = exact)", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, lower=0.01, upper=0.99, accuracy=0):
        super().__init__()
        self._setDefault(lower=0.01, upper=0.99, accuracy=0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> QuantileClipperModel:
        acc = self.getOrDefault(self.accuracy) or None
        qs = (self.getOrDefault(self.lower), self.getOrDefault(self.upper))
        cols = self.getInputCols()
        if acc is None:
            q = global_quantiles(df, cols, qs)
        else:
            row = df.agg(*[_quantiles(c, qs, acc).alias(c) for c in cols]).first()
            q = {c: row[c] or [None, None] for c in cols}
        lows = _floats([q[c][0] for c in cols])
        highs = _floats([q[c][1] for c in cols])
        return self._copy_cols(QuantileClipperModel())._set(lows=lows, highs=highs)


# ---------------------------------------------------------------- min-max scaler
class MinMaxScalerModel(Model, _ColsMixin):
    mins = Param(Params._dummy(), "mins", "minimums", TypeConverters.toListFloat)
    maxs = Param(Params._dummy(), "maxs", "maximums", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for i, o, lo, hi in zip(self.getInputCols(), self._outs(), self.getOrDefault(self.mins),
                                self.getOrDefault(self.maxs)):
            rng = hi - lo
            if math.isnan(rng) or rng == 0:
                out[o] = F.when(F.col(i).isNotNull(), F.col(i) - F.col(i)).cast("double")
            else:
                out[o] = ((F.col(i) - F.lit(lo)) / F.lit(rng)).cast("double")
        return df.withColumns(out)


class MinMaxScaler(Estimator, _ColsMixin):
    """Column-wise (x − min) / (max − min); a constant column maps to 0.0
    (MLlib's MinMaxScaler gives 0.5)."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MinMaxScalerModel:
        cols = self.getInputCols()
        row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"{c}__min") for c in cols],
                     *[F.max(F.col(c).cast("double")).alias(f"{c}__max") for c in cols]).first()
        return self._copy_cols(MinMaxScalerModel())._set(
            mins=_floats([row[f"{c}__min"] for c in cols]), maxs=_floats([row[f"{c}__max"] for c in cols]))


# ---------------------------------------------------------------- clip + min-max in one stage
class ClipScaler(QuantileClipper):
    """Quantile clip followed by min-max scaling, fitted in one quantile
    pass: after clipping to [lo, hi] the fitted minimum is exactly lo and the
    maximum exactly hi (lo, hi are quantiles of the same data), so the
    separate min-max fit is redundant. Output equals QuantileClipper →
    MinMaxScaler (constant column → 0.0, NULL kept)."""

    def _fit(self, df: DataFrame) -> "ClipScalerModel":
        q = super()._fit(df)
        m = ClipScalerModel()
        m._set(inputCols=q.getInputCols(), outputCols=q._outs(), lows=q.getOrDefault(q.lows),
               highs=q.getOrDefault(q.highs))
        return m


class ClipScalerModel(QuantileClipperModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for i, o, lo, hi in zip(self.getInputCols(), self._outs(), self.getOrDefault(self.lows),
                                self.getOrDefault(self.highs)):
            if math.isnan(lo) or math.isnan(hi):
                out[o] = F.when(F.col(i).isNotNull(), F.col(i) - F.col(i)).cast("double")
            elif hi == lo:
                out[o] = F.when(F.col(i).isNotNull(), F.lit(0.0))
            else:
                out[o] = ((clip(i, lo, hi) - F.lit(lo)) / F.lit(hi - lo)).cast("double")
        return df.withColumns(out)


# ---------------------------------------------------------------- standard scaler (population)
class StandardScalerModel(Model, _ColsMixin):
    means = Param(Params._dummy(), "means", "means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population standard deviations", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for i, o, m, s in zip(self.getInputCols(), self._outs(), self.getOrDefault(self.means),
                              self.getOrDefault(self.stds)):
            out[o] = ((F.col(i) - F.lit(m)) / F.lit(s if s and not math.isnan(s) else 1.0)).cast("double")
        return df.withColumns(out)


class StandardScaler(Estimator, _ColsMixin):
    """Column-wise z-score with the population standard deviation (a zero
    deviation leaves the centred value)."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> StandardScalerModel:
        cols = self.getInputCols()
        row = df.agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_pop(c).alias(f"{c}__s") for c in cols]).first()
        return self._copy_cols(StandardScalerModel())._set(
            means=_floats([row[f"{c}__m"] for c in cols]), stds=_floats([row[f"{c}__s"] for c in cols]))


# ---------------------------------------------------------------- stabiliser
class Stabilizer(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """NaN / ±inf → 0 and clamp to ±bound, on numeric columns."""
    bound = Param(Params._dummy(), "bound", "absolute clamp", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, bound=15.0):
        super().__init__()
        self._setDefault(bound=15.0, inputCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        b = self.getOrDefault(self.bound)
        out = {c: clip(nan_inf_to_zero(c), -b, b) for c in self.getInputCols()}
        return df.withColumns(out)


# ---------------------------------------------------------------- variance selector
class VarianceSelectorModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    featuresCol = Param(Params._dummy(), "featuresCol", "input vector", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "selected vector", TypeConverters.toString)
    indices = Param(Params._dummy(), "indices", "kept slots", TypeConverters.toListInt)

    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        sl = VectorSlicer(inputCol=self.getOrDefault(self.featuresCol), outputCol=self.getOrDefault(self.outputCol),
                          indices=self.getOrDefault(self.indices))
        return sl.transform(df)


class VarianceSelector(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Keep vector slots whose *population* variance exceeds the threshold
    (MLlib's VarianceThresholdSelector uses the sample variance)."""
    featuresCol = Param(Params._dummy(), "featuresCol", "input vector", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "selected vector", TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "variance threshold", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", outputCol="selected", threshold=1e-4):
        super().__init__()
        self._setDefault(featuresCol="features", outputCol="selected", threshold=1e-4)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> VarianceSelectorModel:
        fc = self.getOrDefault(self.featuresCol)
        r = df.select(Summarizer.metrics("variance", "count").summary(F.col(fc)).alias("s")).first()["s"]
        n, var = r["count"], r["variance"].toArray()
        pop = var * ((n - 1) / n) if n > 0 else var
        keep = [i for i, v in enumerate(pop) if v > self.getOrDefault(self.threshold)]
        m = VarianceSelectorModel()
        return m._set(featuresCol=fc, outputCol=self.getOrDefault(self.outputCol), indices=keep)


def population_variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, variance) with population variance per numeric column."""
    a = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in columns])
    return a.unpivot([], columns, "feature", "variance")


# ---------------------------------------------------------------- column transformer
def one_hot_stages(categorical: list[str]) -> list:
    """StringIndexer (alphabetical, unseen/NULL kept as an extra index) +
    OneHotEncoder(dropLast) → exactly one slot per seen category, unseen
    and NULL all-zero."""
    idx = [f"{c}__idx" for c in categorical]
    oh = [f"{c}__oh" for c in categorical]
    return [StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep",
                          stringOrderType="alphabetAsc"),
            # the indexer's extra "invalid" index is the last category: dropLast removes it
            OneHotEncoder(inputCols=idx, outputCols=oh, dropLast=True)]


def preprocessor(numeric: list[str], categorical: list[str], features_col: str = "features",
                 impute_categorical: bool = True, accuracy: int = 0) -> Pipeline:
    """Numeric: median impute → 1–99 % quantile clip → min-max (constant → 0),
    the last two fitted together (:class:`ClipScaler`).
    Categorical: mode impute → one-hot. Assembled into one vector whose
    slot names (ML attributes) follow ``<column>`` / ``<column>_<value>``."""
    num_out = [f"{c}__num" for c in numeric]
    cat_in = [f"{c}__cat" for c in categorical] if impute_categorical else categorical
    stages = [MedianImputer(inputCols=numeric, outputCols=num_out, accuracy=accuracy),
              ClipScaler(inputCols=num_out, accuracy=accuracy)]  # = QuantileClipper → MinMaxScaler
    if categorical:
        if impute_categorical:
            stages.append(ModeImputer(inputCols=categorical, outputCols=cat_in))
        stages += one_hot_stages(cat_in)
    stages.append(VectorAssembler(inputCols=num_out + [f"{c}__oh" for c in cat_in], outputCol=features_col,
                                  handleInvalid="keep"))
    return Pipeline(stages=stages)


def imputed_bounds(n: int, missing: int, values: dict[int, float], qs: tuple[float, float]) -> tuple[float, list[float]]:
    """Median of ``n`` sorted values and, once ``missing`` copies of it are added, the quantiles ``qs``.

    ``values`` has the values at the ranks of :func:`imputed_ranks`: a rank of the longer list is one of the
    shorter below the median, is the median itself, or is one of the shorter ``missing`` places earlier."""
    def between(h, at):
        lo, hi = at(math.floor(h)), at(math.ceil(h))
        return lo if lo == hi else (math.ceil(h) - h) * lo + (h - math.floor(h)) * hi
    if not n:
        return math.nan, [math.nan] * len(qs)
    median = between(0.5 * (n - 1), values.__getitem__)

    def at(k):
        if k < n and values[k] < median:
            return values[k]
        return values[k - missing] if k >= missing and values[k - missing] > median else median
    return median, [between(q * (n + missing - 1), at) for q in qs]


def imputed_ranks(n: int, missing: int, qs: tuple[float, float]) -> list[int]:
    """The ranks of ``n`` values that :func:`imputed_bounds` needs."""
    out = {math.floor(0.5 * (n - 1)), math.ceil(0.5 * (n - 1))}
    for q in qs:
        h = q * (n + missing - 1)
        out |= {k - less for k in (math.floor(h), math.ceil(h)) for less in (0, missing) if 0 <= k - less < n}
    return sorted(out) if n else []


def fit_preprocessors(df: DataFrame, numeric: list[str], categorical: list[str], fold: str | None = None, folds: int = 0,
                      lower: float = 0.01, upper: float = 0.99, features_col: str = "features") -> list[PipelineModel]:
    """The fitted :func:`preprocessor` of the rows outside each fold, and last of all rows.

    The statistics of a training set are those of all rows minus its own fold's: category counts are taken
    once by (fold, column, value), numbers once by (fold, column, digits), for all folds together, and the
    medians and clip bounds of all columns come from one selection. Without ``fold`` there is one model.
    What reaches the driver: category levels, and about ten values for each fold and numeric column."""
    spark, qs = df.sparkSession, (lower, upper)
    of = F.col(fold).cast("int") if fold else F.lit(0)
    models, count = folds + 1 if fold else 1, folds if fold else 0
    rows = df.select(of.alias("_f"), *numeric, *(F.col(c).cast("string").alias(c) for c in categorical)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        values = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(categorical)),
                                   *(F.struct(F.lit(len(categorical) + i).alias("i"), F.when(F.col(c).isNull() | F.isnan(c), "0").otherwise("1").alias("v"))
                                     for i, c in enumerate(numeric)))).alias("p")
        counts: dict[tuple[int, int], dict] = {}
        for r in rows.select("_f", values).groupBy("_f", "p.i", "p.v").agg(F.count(F.lit(1)).alias("n")).collect():
            for m in range(models):
                if not fold or r["_f"] != m:  # the last model has all rows
                    of_m = counts.setdefault((m, r["i"]), {})
                    of_m[r["v"]] = of_m.get(r["v"], 0) + r["n"]
        ends = []
        for m in range(models):
            for i in range(len(numeric)):
                seen = counts.get((m, len(categorical) + i), {})
                ends.append((m, i, seen.get("1", 0), seen.get("0", 0)))
        wanted = spark.createDataFrame([(m, i, k) for m, i, n, missing in ends for k in imputed_ranks(n, missing, qs)] or [(-1, -1, -1)],
                                       "_g int, _c int, _k long").select("_g", "_c", F.lit(0).alias("_j"), F.lit(0.0).alias("_h"), "_k")
        at: dict[tuple[int, int], dict[int, float]] = {}
        if numeric:
            stored = code_rows(rows, F.col("_f"), numeric).where(F.col("_code").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
            got = values_at_ranks(stored, lambda totals: wanted.join(totals.select("_g", "_c"), ["_g", "_c"]), count or None)
            for r in got.select("_g", "_c", "_k", order_number(F.col("_code")).alias("x")).collect():
                at.setdefault((r["_g"], r["_c"]), {})[r["_k"]] = r["x"]
            stored.unpersist()
        bounds = {(m, i): imputed_bounds(n, missing, at.get((m, i), {}), qs) for m, i, n, missing in ends}
    finally:
        rows.unpersist()

    def levels(m, i):
        return {v: n for v, n in counts.get((m, i), {}).items() if v is not None}
    num_out, cat_in = [f"{c}__num" for c in numeric], [f"{c}__cat" for c in categorical]
    out = []
    for m in range(models):
        stages = [MedianImputerModel()._set(inputCols=numeric, outputCols=num_out, medians=[bounds[m, i][0] for i in range(len(numeric))]),
                  ClipScalerModel()._set(inputCols=num_out, outputCols=num_out, lows=[bounds[m, i][1][0] for i in range(len(numeric))],
                                         highs=[bounds[m, i][1][1] for i in range(len(numeric))])]
        known = [c for i, c in enumerate(cat_in) if levels(m, i)]  # a column without values has no slots
        if known:
            modes = [min(seen, key=lambda v: (-seen[v], v)) if (seen := levels(m, i)) else "\0" for i in range(len(categorical))]
            imputer = ModeImputerModel()._set(inputCols=categorical, outputCols=cat_in, modes=modes)
            _, encoder = one_hot_stages(known)
            indexers = [StringIndexerModel.from_labels(sorted(levels(m, i)), c, f"{c}__idx", "keep")
                        for i, c in enumerate(cat_in) if c in known]
            stages += [imputer, *indexers]
            # sizes are in the indexers' column attributes: no row is read
            stages.append(encoder.fit(PipelineModel(stages=[imputer, *indexers]).transform(df.select(*categorical).limit(0))))
        stages.append(VectorAssembler(inputCols=num_out + [f"{c}__oh" for c in known], outputCol=features_col, handleInvalid="keep"))
        out.append(PipelineModel(stages=stages))
    return out


def feature_names(df: DataFrame, features_col: str = "features") -> list[str]:
    """Slot names of an assembled vector from its ML attribute metadata
    (numeric ``x__num`` → ``num__x``, one-hot ``c__cat__oh`` + value →
    ``cat__c_value``); falls back to ``f<i>``."""
    meta = df.schema[features_col].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    names = {}
    for a in attrs:
        n = a.get("name", "")
        if "__oh_" in n:
            col, val = n.split("__oh_", 1)
            col = col.replace("__cat", "").replace("__idx", "")
            names[a["idx"]] = f"cat__{col}_{val}"
        elif n.endswith("__num"):
            names[a["idx"]] = f"num__{n[:-5]}"
        else:
            names[a["idx"]] = n
    size = meta.get("num_attrs", len(names))
    return [names.get(i, f"f{i}") for i in range(size)]


def vector_slots(df: DataFrame, vec: str, out: str = "_arr") -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col(vec)))
