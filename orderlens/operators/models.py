"""Classifiers, regressors, validation and importances.

Trainers return ``pyspark.ml`` ``PipelineModel``s (preprocessor + model) so
fitting, persistence and scoring are the standard MLlib ones. Only model
parameters (bounded by classes × features) ever reach the driver.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from . import svm, trees
from .prep import VarianceSelector, VarianceSelectorModel, feature_names, fit_preprocessors
from .split import sample_n, with_class_weights, with_stratified_folds


# ---------------------------------------------------------------- Gaussian naive Bayes
class GaussianNBModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "class labels", TypeConverters.toListFloat)
    logPriors = Param(Params._dummy(), "logPriors", "log class priors", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "k×d means, row-major", TypeConverters.toListFloat)
    variances = Param(Params._dummy(), "variances", "k×d smoothed variances", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        cls = self.getOrDefault(self.classes)
        k = len(cls)
        mu, var = self.getOrDefault(self.means), self.getOrDefault(self.variances)
        d = len(mu) // k
        tmp = "_nb_x"
        x = F.col(tmp)
        lls = []
        for c in range(k):
            const = self.getOrDefault(self.logPriors)[c] - 0.5 * sum(math.log(2 * math.pi * v)
                                                                     for v in var[c * d:(c + 1) * d])
            # explicit per-slot terms with literal parameters: stays inside
            # whole-stage codegen (a higher-order aggregate would not)
            quad = F.lit(0.0)
            for j in range(d):
                diff = x.getItem(j) - F.lit(mu[c * d + j])
                quad = quad + diff * diff * F.lit(1.0 / (2.0 * var[c * d + j]))
            lls.append(F.lit(const) - quad)
        names = [f"_nb_ll{c}" for c in range(k)]
        out = df.withColumn(tmp, vector_to_array(F.col(self.getOrDefault(self.featuresCol))))
        out = out.withColumns(dict(zip(names, lls)))  # each log-likelihood computed once
        ll = [F.col(n) for n in names]
        best = ll[0]
        pred = F.lit(cls[0])
        for c in range(1, k):  # first class wins ties (argmax)
            pred = F.when(ll[c] > best, F.lit(cls[c])).otherwise(pred)
            best = F.greatest(best, ll[c])
        mx = F.greatest(*ll) if k > 1 else ll[0]
        z = sum((F.exp(v - mx) for v in ll), F.lit(0.0))
        probs = F.array(*[F.exp(v - mx) / z for v in ll])
        return out.withColumn("prediction", pred).withColumn("nb_probability", probs).drop(tmp, *names)


class GaussianNB(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Gaussian naive Bayes with variance smoothing ``varSmoothing ·
    max(population variance)`` added to every per-class variance, then a
    floor of ``varFloor`` (MLlib's NaiveBayes(modelType='gaussian') has a
    fixed smoothing). Fit = one grouped ``Summarizer`` pass per class plus
    one global pass; scoring = literal expressions (no join)."""
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    varSmoothing = Param(Params._dummy(), "varSmoothing", "share of max variance added", TypeConverters.toFloat)
    varFloor = Param(Params._dummy(), "varFloor", "minimum variance", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", varSmoothing=1e-4, varFloor=1e-4):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", varSmoothing=1e-4, varFloor=1e-4)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> GaussianNBModel:
        fc, lc = self.getOrDefault(self.featuresCol), self.getOrDefault(self.labelCol)
        s = Summarizer.metrics("mean", "variance", "count")
        per = (df.groupBy(F.col(lc).cast("double").alias("c")).agg(s.summary(F.col(fc)).alias("s"))
               .orderBy("c").collect())  # one row per class
        glob = df.select(s.summary(F.col(fc)).alias("s")).first()["s"]
        n_all = glob["count"]
        gvar = glob["variance"].toArray() * ((n_all - 1) / n_all if n_all > 1 else 0.0)
        eps = self.getOrDefault(self.varSmoothing) * float(gvar.max() if len(gvar) else 0.0)
        floor = self.getOrDefault(self.varFloor)
        classes, priors, means, variances = [], [], [], []
        for r in per:
            n = r["s"]["count"]
            v = r["s"]["variance"].toArray() * ((n - 1) / n if n > 1 else 0.0)
            classes.append(float(r["c"]))
            priors.append(math.log(n / n_all))
            means.extend(float(x) for x in r["s"]["mean"].toArray())
            variances.extend(max(float(x) + eps, floor) for x in v)
        return GaussianNBModel()._set(featuresCol=fc, classes=classes, logPriors=priors, means=means,
                                      variances=variances)


# ---------------------------------------------------------------- model zoo
# A forest's tree without a depth of its own grows to this one: 2**17 nodes a tree at most.
DEEPEST = 16


def forest_of(params: dict) -> trees.Forest:
    depth = params.get("max_depth")
    return trees.Forest(params.get("n_estimators", 200), DEEPEST if depth is None else min(depth, DEEPEST),
                        params.get("min_samples_leaf", 1), params.get("max_features", "sqrt"), params.get("seed", 42))


def boost_of(params: dict) -> trees.Boost:
    return trees.Boost(params.get("n_estimators", 300), params.get("learning_rate", 0.1), params.get("max_depth", 6),
                       params.get("subsample", 0.8), params.get("colsample_bytree", 0.8), params.get("min_child_weight", 1),
                       params.get("reg_lambda", 1.0), params.get("scale_pos_weight", 1.0), params.get("seed", 42))


CLASSIFIERS = ("naive_bayes", "logistic", "linear_svm", "random_forest", "gbt")


def make_classifier(name: str, features: str = "features", label: str = "label", weight: str | None = "weight",
                    **params):
    """An MLlib (or own) classifier configured like the reference's choice."""
    w = {"weightCol": weight} if weight else {}
    if name == "naive_bayes":
        return GaussianNB(featuresCol=features, labelCol=label, varSmoothing=params.get("var_smoothing", 1e-4))
    if name == "logistic":
        return LogisticRegression(featuresCol=features, labelCol=label, regParam=params.get("alpha", 0.001),
                                  elasticNetParam=0.0, standardization=False, maxIter=params.get("max_iter", 100),
                                  tol=1e-3, **w)
    if name == "linear_svm":
        return svm.LinearSVM(featuresCol=features, labelCol=label, weightCol=weight or "", cost=float(params.get("C", 1.0)),
                             interceptScale=float(params.get("intercept_scale", 1.0)), maxRounds=params.get("max_rounds", 60))
    if name == "random_forest":
        return trees.RandomForest(forest_of(params), features, label, weight, params.get("key", "order_id"))
    if name == "gbt":
        return trees.BoostedTrees(boost_of(params), features, label, weight, params.get("key", "order_id"))
    raise ValueError(f"unknown classifier {name!r}")


def classifier_stages(name: str, weight: str | None = "weight", variance_threshold: float | None = None,
                      **params) -> list:
    """(variance selector) → classifier, after the preprocessor. Its vectors are min-max scaled to [0, 1],
    where a stabiliser clamping to ±15 changes nothing; ``prep.Stabilizer`` is there for other inputs."""
    stages, feats = [], "features"
    if variance_threshold is not None:
        stages.append(VarianceSelector(featuresCol="features", outputCol="selected", threshold=variance_threshold))
        feats = "selected"
    stages.append(make_classifier(name, feats, "label", weight, **params))
    return stages


# the reference balances class weights for these two only
BALANCED_BY_DEFAULT = ("logistic", "linear_svm")


def train_classifier(train: DataFrame, name: str, numeric: list[str], categorical: list[str],
                     balanced: bool | None = None, pre: PipelineModel | None = None, **params) -> PipelineModel:
    """Fit one classifier on a supervised frame (``label`` + features), with the preprocessor ``pre`` where it is
    fitted already. Balanced class weights by default for logistic regression and the linear SVM, none for naive
    Bayes and the tree ensembles (as the reference); ``balanced`` overrides."""
    use_w = (name in BALANCED_BY_DEFAULT) if balanced is None else (balanced and name != "naive_bayes")
    # every estimator stage scans the input: persist it once (recomputable
    # from lineage if an executor is lost)
    base = train.persist(StorageLevel.MEMORY_AND_DISK)
    pre = pre or fit_preprocessors(base, numeric, categorical)[-1]
    data = pre.transform(with_class_weights(base, "label") if use_w else base)
    model = Pipeline(stages=classifier_stages(name, "weight" if use_w else None, 1e-4 if name == "naive_bayes" else None, **params)).fit(data)
    base.unpersist()
    return PipelineModel(stages=[*pre.stages, *model.stages])


def predict(model: PipelineModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Score a batch: prediction (and probability when the model has one)."""
    out = model.transform(df)
    cols = [c for c in (keep or []) if c in out.columns] + ["prediction"]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability").alias("probability"))
    for own in ("nb_probability", "tree_probability"):
        if own in out.columns:
            cols.append(F.col(own).alias("probability"))
    return out.select(*cols)


def folded(train: DataFrame, numeric: list[str], categorical: list[str], k: int = 3,
           seed: int = 7) -> tuple[DataFrame, list[PipelineModel]]:
    """The rows with stratified folds, stored, and the preprocessor of each fold's training rows (and last of all rows)."""
    data = with_stratified_folds(train, k, seed=seed).persist(StorageLevel.MEMORY_AND_DISK)
    return data, fit_preprocessors(data, numeric, categorical, "fold", k)


def cross_validate(train: DataFrame, name: str, numeric: list[str], categorical: list[str], k: int = 3,
                   seed: int = 7, folds: tuple[DataFrame, list[PipelineModel]] | None = None, **params) -> DataFrame:
    """k-fold CV on stratified folds: fit on the other folds, score the held-out fold, metrics
    per fold, then mean and population std per metric (long form). The folds' preprocessors come
    from one set of statistics (``prep.fit_preprocessors``), pass ``folds`` to share it: a pair
    (frame with a ``fold`` column, fitted preprocessors)."""
    data, pre = folds or folded(train, numeric, categorical, k, seed)
    per_fold = []
    for f in range(k):
        m = train_classifier(data.filter(F.col("fold") != f), name, numeric, categorical, pre=pre[f], **params)
        p = predict(m, data.filter(F.col("fold") == f), keep=["label"])
        row = M.metrics_dict(M.confusion_counts(p))
        per_fold.append((f, float(row["accuracy"]), float(row["f1_weighted"]), float(row["precision_weighted"]),
                         float(row["recall_weighted"])))
    if folds is None:
        data.unpersist()
    spark = train.sparkSession
    scores = spark.createDataFrame(per_fold, "fold int, accuracy double, f1_weighted double, "
                                            "precision_weighted double, recall_weighted double")
    cols = ["accuracy", "f1_weighted", "precision_weighted", "recall_weighted"]
    long = scores.unpivot(["fold"], cols, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")) \
               .select(F.lit(name).alias("model"), "metric", "mean", "std")


# Search spaces of the randomised searches (no depth: DEEPEST).
RF_GRID = {
    "n_estimators": [200, 300, 400],
    "max_depth": [None, 10, 20, 30],
    "min_samples_leaf": [1, 2, 5],
    "max_features": ["sqrt", "log2", 0.5],
    "class_weight": [None, "balanced", {0: 2, 1: 1}, {0: 3, 1: 1}],
}
GBT_GRID = {
    "n_estimators": [200, 400, 600],
    "learning_rate": [0.03, 0.05, 0.1],
    "max_depth": [3, 5, 7],
    "subsample": [0.8, 1.0],
    "colsample_bytree": [0.7, 1.0],
    "min_child_weight": [1, 3, 5],
    "reg_lambda": [1, 2, 5],
    "scale_pos_weight": [1, 3, 5],
}


def sample_grid(grid: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` distinct parameter combinations drawn with a seed."""
    sizes = [len(v) for v in grid.values()]
    out = []
    for number in random.Random(seed).sample(range(math.prod(sizes)), min(n_iter, math.prod(sizes))):
        combo = {}
        for name, values in grid.items():
            number, at = divmod(number, len(values))
            combo[name] = values[at]
        out.append(combo)
    return out


def weights_of(choice, sizes: dict[float, int]) -> dict[float, float]:
    """Weights of the labels, given how many rows have each: none, balanced, or one for each class."""
    if choice is None:
        return dict.fromkeys(sizes, 1.0)
    if choice == "balanced":
        return {y: sum(sizes.values()) / (len(sizes) * n) for y, n in sizes.items()}
    return {y: float(choice.get(int(y), 1.0)) for y in sizes}


def bounded_rows(train: DataFrame, fit_rows: int | None, seed: int = 42) -> DataFrame:
    """At most ``fit_rows`` labelled rows, those with the smallest seeded key
    hashes (None: all rows)."""
    return train if fit_rows is None else sample_n(train, fit_rows, seed=seed)


def random_search(train: DataFrame, name: str, numeric: list[str], categorical: list[str], grid: dict,
                  n_iter: int = 10, k: int = 3, seed: int = 42, fit_rows: int | None = None, key: str = "order_id") -> tuple[PipelineModel, DataFrame]:
    """Seeded sample of a grid for a tree ensemble, k stratified folds, refit of the best on all rows.

    Draws are compared on all rows (``fit_rows``: at most so many, those with the smallest key hashes). Each fold
    has its own medians, bounds, levels and cuts, those of its training rows alone; its rows are binned once for all
    draws. Each (draw, fold) fits on the rows of the other folds and counts the hits on its own. The best draw is fitted
    anew on the whole ``train``. Returns that model (whole pipeline) and (params, mean_accuracy) rows; weighted recall
    equals accuracy."""
    params = sample_grid(grid, n_iter, seed)
    data, pre = folded(bounded_rows(train, fit_rows, seed), numeric, categorical, k, seed + 1)
    layouts, blocks = [], []
    for f in range(k):
        vectors = pre[f].transform(data)
        layouts.append(trees.layout_of(vectors.where(F.col("fold") != f), "features"))
        blocks.append(trees.blocks_of(vectors, layouts[f], "features", "label", None, key, "fold"))
    data.unpersist()
    shares: dict[int, list[float]] = {i: [] for i in range(len(params))}
    for i, hits, n in hits_of(name, params, blocks, layouts):
        if n:
            shares[i].append(hits / n)
    for held in blocks:
        held.unpersist()
    if not any(shares.values()):
        raise ValueError("no rows to compare draws on")
    scores = [sum(s) / len(s) for s in shares.values()]
    best = params[max(range(len(params)), key=lambda i: (scores[i], -i))]
    weights = best.get("class_weight")
    fitted = train if weights is None or weights == "balanced" else train.withColumn(
        "weight", F.coalesce(*(F.when(F.col("label") == c, float(w)) for c, w in weights.items()), F.lit(1.0)))
    if isinstance(weights, dict):
        pre_all = fit_preprocessors(fitted, numeric, categorical)[-1]
        last = make_classifier(name, weight="weight", **best).fit(pre_all.transform(fitted))
        model = PipelineModel(stages=[*pre_all.stages, last])
    else:
        model = train_classifier(fitted, name, numeric, categorical, balanced=weights == "balanced", **best)
    table = [(str(p), float(scores[i])) for i, p in enumerate(params)]
    return model, train.sparkSession.createDataFrame(table, "params string, mean_accuracy double")


def hits_of(name: str, params: list[dict], blocks: list, layouts: list[trees.Layout]) -> list[tuple[int, int, int]]:
    """(draw, rows that its model gets right, rows) of each draw and fold, given the folds' blocks (RDDs).

    A forest's trees are spread over the tasks. Boosting goes through its trees one after the other: while there are few
    enough rows each (draw, fold) is one task, else a level is a job."""
    counts = blocks[0].map(lambda b: Counter(zip(b.fold.tolist(), b.y.tolist()))).fold(Counter(), lambda a, b: a + b)  # of few classes

    def weights(draw: int, f: int) -> dict[float, float]:
        sizes = Counter()
        for (fold, y), n in counts.items():
            sizes[y] += n * (fold != f)
        return weights_of(params[draw].get("class_weight"), {y: n for y, n in sizes.items() if n})
    if name == "gbt" and sum(counts.values()) <= trees.ONE_TASK_ROWS:
        return _boosted_hits([boost_of(p) for p in params], blocks, layouts, weights)
    out = []
    for f, (held, layout) in enumerate(zip(blocks, layouts)):
        for draw, own in enumerate(params):
            rows = held.map(lambda b, f=f, w=weights(draw, f): _weighted(b.rows(b.fold != f), w))
            if name == "gbt":
                grown, start = trees.boost_blocks(rows, layout, boost_of(own))
                limit = -start
            else:
                grown = trees.forest_blocks(rows, layout, forest_of(own))
                limit = 0.5 * len(grown)
            sent = held.context.broadcast([replace(t, gain=np.empty(0)) for t in grown])

            def hits(b, f=f, sent=sent, limit=limit):
                test = b.rows(b.fold == f)
                return np.array([((trees.score_sum(test, sent.value) > limit) == (test.y == 1)).sum(), len(test.y)])
            right, n = held.map(hits).fold(np.zeros(2, dtype=np.int64), np.add).tolist()
            out.append((draw, right, n))
            sent.unpersist()
    return out


def _weighted(block, weights: dict[float, float]):
    """A block's rows with their labels' weights."""
    labels, at = np.unique(block.y, return_inverse=True)
    return replace(block, w=np.array([weights.get(y, 1.0) for y in labels.tolist()])[at])


def _boosted_hits(draws: list[trees.Boost], blocks: list, layouts: list[trees.Layout], weights) -> list[tuple[int, int, int]]:
    """:func:`hits_of` where each (draw, fold) is one task, the longest first."""
    tasks = sorted(((i, f) for i in range(len(draws)) for f in range(len(blocks))), key=lambda t: -draws[t[0]].rounds * draws[t[0]].depth)
    heavy = [weights(i, f) for i, f in tasks]

    def copies(f: int):
        own, layout = [g for g, t in enumerate(tasks) if t[1] == f], layouts[f]

        def run(at, found):
            for b in found:
                lean = trees.Lean.of(b, layout)
                yield from ((g, (at, lean, b.fold)) for g in own)
        return blocks[f].mapPartitionsWithIndex(run)

    def fit(item):
        g, parts = item
        i, f = tasks[g]
        parts = sorted(parts, key=lambda p: p[0])
        rows, fold = trees.Lean.joined([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        grown, start = trees.boost_rows(_weighted(rows.rows(fold != f), heavy[g]), layouts[f], draws[i])
        test = rows.rows(fold == f)
        return i, int(((trees.score_sum(test, grown) > -start) == (test.y == 1)).sum()), len(test.y)
    return blocks[0].context.union([copies(f) for f in range(len(blocks))]).groupByKey(len(tasks), lambda g: g).map(fit).collect()


# ---------------------------------------------------------------- regression
def train_regression(train: DataFrame, numeric: list[str], categorical: list[str], ridge: bool = False,
                     alpha: float = 0.001) -> PipelineModel:
    """Preprocessor → least squares, or ridge: the minimum of mean((y - Xw - b)^2) / 2 + alpha |w|^2 / 2.
    (The solver takes its penalty for labels of unit deviation.)"""
    pre = fit_preprocessors(train, numeric, categorical)[-1]
    std = train.agg(F.stddev_pop("label")).first()[0]
    reg = LinearRegression(featuresCol="features", labelCol="label", regParam=alpha * (std or 0.0) if ridge else 0.0,
                           elasticNetParam=0.0, standardization=False, solver="normal")
    return PipelineModel(stages=[*pre.stages, reg.fit(pre.transform(train))])


# ---------------------------------------------------------------- importances
# how much each slot of the feature vector counts, by type of fitted model
SLOT_WEIGHTS = {
    trees.TreeModel: lambda m: m.importances(),
    LogisticRegressionModel: lambda m: np.abs(m.coefficientMatrix.toArray()).mean(axis=0),
    svm.LinearSVMModel: lambda m: np.abs(m.getOrDefault(m.weights)),
    LinearRegressionModel: lambda m: np.abs(m.coefficients.toArray()),
}


def feature_importance(model: PipelineModel, scored_sample: DataFrame) -> DataFrame:
    """(feature, importance) of every slot that the model reads.

    ``scored_sample`` is any frame transformed by the model: the attributes
    of its vector column name the slots. Models without slot weights (naive
    Bayes) give no rows; names that don't fit the weights raise."""
    fitted = model.stages[-1]
    weigh = SLOT_WEIGHTS.get(type(fitted))
    rows = []
    if weigh is not None:
        named = feature_names(scored_sample, "features")
        for stage in model.stages:
            if isinstance(stage, VarianceSelectorModel):
                named = [named[i] for i in stage.getOrDefault(stage.indices)]
        rows = [(n, float(w)) for n, w in zip(named, weigh(fitted), strict=True)]
    return scored_sample.sparkSession.createDataFrame(rows, "feature string, importance double")
