"""Choice of thresholds: count cubes, folds and refinement, and a Spark ML pipeline that calibrates, unifies and cuts scores.

A search over a grid of thresholds reads the rows once: each row becomes the number of thresholds that it
passes on each axis, and rows are counted by these numbers, class and fold. That cube is as large as the grid, whatever the table. Sums over
all cells that dominate a cell give the hits of every setting; a fold's training counts are the whole's less its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import holds, unified_score
from ..session import workspace
from . import evaluate

Grid = dict[str, list[float]]
#: Axes in the order of the grid; a pair counts as found if it passes the first two or the third.
AXES = ("cosine", "ssim", "orb_inliers")
FOLDED: Grid = {"cosine": [0.90, 0.92, 0.94, 0.96], "ssim": [0.85, 0.90, 0.95], "orb_inliers": [0, 20, 30]}
COARSE: Grid = {"cosine": [k / 100 for k in range(90, 100)], "ssim": [k / 100 for k in range(85, 97, 2)], "orb_inliers": [0, 20, 30]}
#: The setting when none reaches the precision.
FALLBACK = (0.96, 0.90, 30)


@dataclass
class Cube:
    """Counts by fold, class and thresholds passed on each axis."""

    axes: list[list[float]]
    counts: np.ndarray

    def hits(self) -> np.ndarray:
        """fold, class, setting: rows that each setting finds."""
        sums = self.counts
        for axis in (2, 3, 4):
            sums = np.flip(np.cumsum(np.flip(sums, axis), axis=axis), axis)
        both, third = sums[:, :, 1:, 1:, :1], sums[:, :, :1, :1, 1:]
        return both + third - sums[:, :, 1:, 1:, 1:]

    def sizes(self) -> np.ndarray:
        return self.counts.sum(axis=(2, 3, 4))

    def setting(self, at: tuple[int, ...]) -> tuple[float, ...]:
        return tuple(a[i] for a, i in zip(self.axes, at))


def cube(rows: DataFrame, grid: Grid, folds: int = 1) -> Cube:
    """rows (should_detect, cosine, ssim, orb_inliers, fold if folds > 1) counted in one pass; a missing signal is 0, a missing label false."""
    axes = [sorted(grid[a]) for a in AXES]
    value = lambda a: F.coalesce(F.col(a).cast("double"), F.lit(0.0))
    passed = [sum((F.when(value(a) >= float(t), 1).otherwise(0) for t in ts), F.lit(0)).alias(f"_{a}") for a, ts in zip(AXES, axes)]
    fold = F.col("fold") if folds > 1 else F.lit(0)
    found = rows.select(fold.alias("_f"), holds(F.col("should_detect")).cast("int").alias("_y"), *passed).groupBy("_f", "_y", *[f"_{a}" for a in AXES]).count()
    counts = np.zeros((folds, 2, *(len(a) + 1 for a in axes)), "i8")
    for r in found.collect():  # as many rows as the cube has cells
        counts[tuple(r)[:5]] = r["count"]
    return Cube(axes, counts)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def winner(c: Cube, hits: np.ndarray, positives: int, floor: float, fallback: tuple[float, ...]) -> tuple[tuple[float, ...], tuple[int, ...] | None]:
    """The setting with the best recall above 0 among those with precision of at least the floor, the first in grid order among equals; hits: class, setting."""
    tp, fp = hits[1], hits[0]
    recall = np.where(_share(tp, tp + fp) >= floor, _share(tp, np.array(positives)), 0.0)
    at = np.unravel_index(int(np.argmax(recall)), recall.shape)
    return (c.setting(at), at) if recall[at] > 0 else (fallback, None)


def fold_search(rows: DataFrame, grid: Grid | None = None, folds: int = 5, seed: int = 42, floor: float = 0.95, fallback: tuple[float, ...] = FALLBACK) -> DataFrame:
    """One row per fold: the thresholds chosen on the other folds, precision, recall and fpr on the fold itself, whether its thresholds are
    the ones to take (best recall, the first fold among equals), and mean and population deviation over the folds.

    rows: id, should_detect, cosine, ssim, orb_inliers. Folds are dealt within each class.
    """
    spark = rows.sparkSession
    grid = {a: sorted({*(grid or FOLDED)[a], f}) for a, f in zip(AXES, fallback)} if any(f not in (grid or FOLDED)[a] for a, f in zip(AXES, fallback)) else (grid or FOLDED)
    dealt = evaluate.k_folds(rows.select("id", holds(F.col("should_detect")).cast("int").alias("label"), "should_detect", *AXES), folds, seed)
    c = cube(dealt, grid, folds)
    hits, sizes = c.hits(), c.sizes()
    out = []
    for f in range(folds):
        setting, _ = winner(c, hits.sum(axis=0) - hits[f], int(sizes[:, 1].sum() - sizes[f, 1]), floor, fallback)
        tp, fp = (int(hits[(f, k, *(a.index(t) for a, t in zip(c.axes, setting)))]) for k in (1, 0))
        rates = [float(_share(np.array(x), np.array(y))) for x, y in ((tp, tp + fp), (tp, sizes[f, 1]), (fp, sizes[f, 0]))]
        out.append((f, float(setting[0]), float(setting[1]), int(setting[2]), *rates))
    best = max(range(folds), key=lambda f: (out[f][5], -f))
    stats = [v for k in (5, 4, 6) for v in (float(np.mean([r[k] for r in out])), float(np.std([r[k] for r in out])))]
    named = "fold int, cosine_t double, ssim_t double, inliers_t int, precision double, recall double, fpr double, chosen boolean, recall_mean double, recall_sd double, precision_mean double, precision_sd double, fpr_mean double, fpr_sd double"
    return spark.createDataFrame([(*r, r[0] == best, *stats) for r in out], named)


def around(setting: tuple[float, ...]) -> Grid:
    """The fine grid about a coarse setting, in thousandths: cosine by 0.002 within 0.01, SSIM by 0.005 within 0.02, inliers 10 less, the same and 10 more."""
    c, s, n = round(1000 * setting[0]), round(1000 * setting[1]), int(setting[2])
    return {"cosine": [k / 1000 for k in range(max(900, c - 10), min(995, c + 10), 2)], "ssim": [k / 1000 for k in range(max(850, s - 20), min(960, s + 20), 5)], "orb_inliers": sorted({max(0, n - 10), n, n + 10})}


def coarse_to_fine(rows: DataFrame, coarse: Grid | None = None, floor: float = 0.95, fallback: tuple[float, ...] = FALLBACK) -> DataFrame:
    """pass (coarse, fine), thresholds, tp, fp, precision, recall: the best setting of the coarse grid, then of the fine grid around it. Each pass reads the rows once."""
    out, grid = [], coarse or COARSE
    for name in ("coarse", "fine"):
        c = cube(rows, grid)
        hits, positives = c.hits()[0], int(c.sizes()[0, 1])
        setting, at = winner(c, hits, positives, floor, fallback)
        tp, fp = (int(hits[(1, *at)]), int(hits[(0, *at)])) if at else (None, None)
        rates = (tp / (tp + fp), tp / positives) if at else (None, None)
        out.append((name, float(setting[0]), float(setting[1]), int(setting[2]), tp, fp, *rates))
        grid = around(setting)
    return rows.sparkSession.createDataFrame(out, "pass string, cosine_t double, ssim_t double, inliers_t int, tp long, fp long, precision double, recall double")


# --- pipeline -----------------------------------------------------------------------------


class _Columns(Params):
    labelCol = Param(Params._dummy(), "labelCol", "label, 0 or 1", TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "score that is read", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column that is added", TypeConverters.toString)

    def _of(self, name: str) -> str:
        return self.getOrDefault(self.getParam(name))


class CalibratorModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """A piecewise linear map of the score's logistic value (Platt: one piece) or of the score (isotonic) to a probability."""

    method = Param(Params._dummy(), "method", "platt or isotonic", TypeConverters.toString)
    slope = Param(Params._dummy(), "slope", "of Platt's logit", TypeConverters.toFloat)
    offset = Param(Params._dummy(), "offset", "of Platt's logit", TypeConverters.toFloat)
    boundaries = Param(Params._dummy(), "boundaries", "scores of the isotonic fit", TypeConverters.toListFloat)
    values = Param(Params._dummy(), "values", "probabilities at the boundaries", TypeConverters.toListFloat)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(method="platt", slope=1.0, offset=0.0, boundaries=[], values=[])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = F.coalesce(F.col(self._of("scoreCol")).cast("double"), F.lit(0.0))
        if self._of("method") == "platt":
            return dataset.withColumn(self._of("outputCol"), 1 / (1 + F.exp(-(x * self._of("slope") + self._of("offset")))))
        at, v = self._of("boundaries"), self._of("values")
        grid, held = F.array(*map(F.lit, at)), F.array(*map(F.lit, v))
        n = F.size(F.filter(grid, lambda b: b <= x))  # the piece in which x lies
        lo, hi = F.get(grid, n - 1), F.get(grid, n)
        a, b = F.get(held, n - 1), F.get(held, n)
        inside = F.when(F.get(grid, n - 1) == x, a).otherwise(a + (b - a) * (x - lo) / (hi - lo))
        return dataset.withColumn(self._of("outputCol"), F.when(n == 0, F.lit(v[0])).when(n == len(at), F.lit(v[-1])).otherwise(inside))


class Calibrator(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fits scores to labels: Platt's logistic map with a penalty of 1 / (2 C) of the squared slope beside the sum of losses, or isotonic regression.

    A missing score is 0. Labels of one class alone give the constant share of that class.
    """

    method = Param(Params._dummy(), "method", "platt or isotonic", TypeConverters.toString)
    c = Param(Params._dummy(), "c", "inverse penalty of Platt's slope", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, method: str = "platt", c: float = 1.0, scoreCol: str = "score", labelCol: str = "label", outputCol: str = "calibrated") -> None:
        super().__init__()
        self._setDefault(method="platt", c=1.0, scoreCol="score", labelCol="label", outputCol="calibrated")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CalibratorModel:
        rows = dataset.select(F.coalesce(F.col(self._of("scoreCol")).cast("double"), F.lit(0.0)).alias("x"), F.col(self._of("labelCol")).cast("double").alias("y")).where("y is not null")
        model = CalibratorModel()._set(method=self._of("method"), scoreCol=self._of("scoreCol"), labelCol=self._of("labelCol"), outputCol=self._of("outputCol"))
        # rows that agree are one with their number as its weight, so a fit's size is that of the distinct scores
        data = VectorAssembler(inputCols=["x"], outputCol="v").transform(rows.groupBy("x", "y").agg(F.count("*").cast("double").alias("w")))
        if self._of("method") == "platt":
            n = rows.count()
            fit = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", regParam=1.0 / (self._of("c") * max(1, n)), standardization=False, maxIter=200, tol=1e-10).fit(data)
            return model._set(slope=float(fit.coefficients[0]), offset=float(fit.intercept))
        fit = IsotonicRegression(featuresCol="v", labelCol="y", weightCol="w").fit(data)
        return model._set(boundaries=[float(b) for b in fit.boundaries], values=[float(p) for p in fit.predictions])


class UnifiedScore(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """The larger of the mean of (calibrated) cosine and SSIM and tanh(inliers / 50)."""

    ssimCol = Param(Params._dummy(), "ssimCol", "structural similarity", TypeConverters.toString)
    inliersCol = Param(Params._dummy(), "inliersCol", "geometric inliers", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, scoreCol: str = "calibrated", ssimCol: str = "ssim", inliersCol: str = "orb_inliers", outputCol: str = "unified") -> None:
        super().__init__()
        self._setDefault(scoreCol="calibrated", ssimCol="ssim", inliersCol="orb_inliers", outputCol="unified")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self._of("outputCol"), unified_score(self._of("scoreCol"), self._of("ssimCol"), self._of("inliersCol")))


class CutModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    threshold = Param(Params._dummy(), "threshold", "least score that counts", TypeConverters.toFloat)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(threshold=float("inf"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self._of("outputCol"), holds(F.col(self._of("scoreCol")) >= self._of("threshold")))


class Cut(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Chooses the threshold of the best recall with precision of at least the floor; nothing passes if no threshold has it."""

    floor = Param(Params._dummy(), "floor", "least precision", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, floor: float = 0.95, scoreCol: str = "unified", labelCol: str = "label", outputCol: str = "was_detected") -> None:
        super().__init__()
        self._setDefault(floor=0.95, scoreCol="unified", labelCol="label", outputCol="was_detected")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CutModel:
        rows = dataset.select(F.col(self._of("labelCol")).cast("int").alias("label"), F.col(self._of("scoreCol")).alias("score"))
        found = evaluate.recall_at_precision(evaluate.pr_curve(rows), self._of("floor")).first()
        model = CutModel()._set(scoreCol=self._of("scoreCol"), labelCol=self._of("labelCol"), outputCol=self._of("outputCol"))
        return model._set(threshold=float(found.threshold)) if found.threshold is not None else model


def tuner(method: str = "platt", floor: float = 0.95) -> Pipeline:
    """Calibrates the cosine, unifies the signals and chooses the threshold. fit() gives a PipelineModel that can be saved and loaded."""
    return Pipeline(stages=[Calibrator(method=method, scoreCol="cosine"), UnifiedScore(), Cut(floor=floor)])


def tuned(rows: DataFrame, method: str = "platt", floor: float = 0.95, folds: int = 5, path: str | None = None) -> tuple[PipelineModel, DataFrame]:
    """The fitted pipeline (saved under path, if given) and one row: n, log loss before and after calibration, average precision and PR area, threshold, recall, fpr there,
    and the thresholds and mean recall of the folds. rows: id, label, should_detect, cosine, ssim, orb_inliers.
    """
    model = tuner(method, floor).fit(rows)
    if path:
        model.write().overwrite().save(path)
    scored = model.transform(rows)
    loss = lambda c, name: evaluate.log_loss(scored.select("label", F.coalesce(F.col(c), F.lit(0.0)).alias("score"))).select(F.col("log_loss").alias(name), "n")
    ranked = scored.select("label", F.col("unified").alias("score"))
    cut = model.stages[2].getOrDefault("threshold")
    cv = fold_search(rows.withColumn("cosine", F.col("cosine")), floor=floor, folds=folds).where("chosen").select("cosine_t", "ssim_t", "inliers_t", "recall_mean", "recall_sd")
    row = loss("cosine", "log_loss_before").join(loss("calibrated", "log_loss_after").drop("n"), F.lit(True)).join(evaluate.average_precision(ranked), F.lit(True))
    found = scored.agg(F.round(evaluate.share(F.count_if(F.col("was_detected") & (F.col("label") == 1)), F.count_if(F.col("label") == 1)), 6).alias("recall"))
    return model, row.join(found, F.lit(True)).join(evaluate.fpr_at(ranked, cut).select("fpr"), F.lit(True)).join(cv, F.lit(True)).withColumn("threshold", F.lit(cut))


FEATURES = ("cosine", "ssim", "hamming")


def classifier(features: tuple[str, ...] = FEATURES) -> Pipeline:
    """Fills missing features with 0, scales them and fits a logistic classifier: see fitted_classifier()."""
    fills = ", ".join(f"coalesce(cast({f} AS double), 0D) AS _{f}" for f in features)
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"), VectorAssembler(inputCols=[f"_{f}" for f in features], outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True),
        LogisticRegression(featuresCol="_z", labelCol="label", probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r"),
    ])


def fitted_classifier(rows: DataFrame, features: tuple[str, ...] = FEATURES, path: str | None = None) -> PipelineModel:
    """A classifier of rows (label and features), saved under path or in the shared folder, and loaded again, to be plugged into an Engine.

    The loaded one has no training summary; that holds the session, which can't be sent to tasks once a run was observed.
    """
    path = path or workspace(rows.sparkSession, "classifier")
    classifier(features).fit(rows).write().overwrite().save(path)
    return PipelineModel.load(path)


def classified(pairs: DataFrame, model: PipelineModel | None, threshold: float = 0.5) -> DataFrame:
    """pairs with classifier_score and classifier_hit; without a model both are null."""
    if model is None:
        return pairs.withColumns({"classifier_score": F.lit(None).cast("double"), "classifier_hit": F.lit(None).cast("boolean")})
    out = model.transform(pairs).withColumn("classifier_score", vector_to_array("_p")[1])
    return out.select(*pairs.columns, "classifier_score", (F.col("classifier_score") >= threshold).alias("classifier_hit"))


def load_classifier(spark: SparkSession, path: str | None) -> PipelineModel | None:
    """The saved classifier, or none where there is no model."""
    if not path:
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return PipelineModel.load(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
