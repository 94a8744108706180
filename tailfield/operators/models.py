"""Models on Spark ML and on the table of bins: preprocessing, tree and linear classifiers, stacking, scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailfield.functions.labels import extreme_label
from tailfield.operators import trees as extra
from tailfield.operators.bagging import Bagged
from tailfield.operators.boosting import DRAWN, EVERY_FOLD, PLAIN, Boosted, Settings, binned, draw_rows
from tailfield.operators.evaluate import ale_curve, binary_metrics
from tailfield.operators.ordering import exact_quantiles
from tailfield.operators.profiles import reference_rank
from tailfield.operators.sampling import blocked_holdout, group_folds
from tailfield.operators.stats import missingness
from tailfield.operators.trees import Bins, ExtraTrees
from tailfield.session import materialise, small_table, spread

EPS = 1e-5


def fit_medians(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact medians; one number per feature comes back to the driver, as for any fit."""
    long = df.select(*features).unpivot([], features, "feature", "value")
    rows = exact_quantiles(long, "value", [0.5], ["feature"], small_groups=True).collect()
    return {r["feature"]: r["quantiles"][0] for r in rows}


class NoFeatures(ValueError):
    """No feature has a value."""


def with_values(features: list[str], medians: dict[str, float]) -> list[str]:
    """The features that have any value; those without are left out of a fit."""
    kept = [f for f in features if f in medians]
    if not kept:
        raise NoFeatures(f"no values in {', '.join(features)}")
    return kept


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.fillna(medians)


def with_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """``weight`` n / (2 * class size)."""
    sizes = df.agg(F.sum(label).cast("double").alias("p"), F.count(label).alias("n")).select(
        F.array(F.col("n") / (2.0 * (F.col("n") - F.col("p"))), F.col("n") / (2.0 * F.col("p"))).alias("w")).scalar()
    return df.withColumn("_w", sizes).withColumn("weight", F.get("_w", F.col(label))).drop("_w")


MAX_DEPTH = 30  # the deepest tree the library builds; leaf size ends growth before
MAX_ITERATIONS = 2500


def classifier(kind: str, trees: int | None = None, depth: int | None = None, seed: int = 42, balanced: bool = True):
    """``forest`` or ``linear`` of Spark ML; for the kinds over the table of bins see ``fit_model``."""
    shared = {"featuresCol": "features", "labelCol": "label"}
    weighted = shared | ({"weightCol": "weight"} if balanced else {})
    if kind == "forest":
        return RandomForestClassifier(**weighted, numTrees=trees or 350, maxDepth=depth or MAX_DEPTH, minInstancesPerNode=2, seed=seed)
    if kind == "linear":
        return LogisticRegression(**weighted, maxIter=MAX_ITERATIONS, tol=1e-9)
    raise ValueError(kind)


class NotConverged(RuntimeError):
    """An iterative fit used all its iterations."""


def require_converged(model) -> None:
    if model.hasSummary and model.summary.totalIterations >= MAX_ITERATIONS:
        raise NotConverged(f"no optimum within {MAX_ITERATIONS} iterations")


def components_for(df: DataFrame, vector: str, n_features: int, share: float = 0.95) -> int:
    """Leading components that reach the wanted share of variance."""
    explained = PCA(k=n_features, inputCol=vector, outputCol="_pc").fit(df).explainedVariance.toArray()
    total = 0.0
    for i, v in enumerate(explained):
        total += v
        if total >= share:
            return i + 1
    return n_features


class FittedModel:
    """Medians, a pipeline and the features it reads; ``predict`` adds ``prediction``."""

    def __init__(self, features: list[str], medians: dict[str, float], pipeline: PipelineModel):
        self.features, self.medians, self.pipeline = features, medians, pipeline

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        renamed = {f: f"_f_{f}" for f in self.features}
        filled = df.withColumns({renamed[f]: F.coalesce(F.col(f), F.lit(self.medians[f])) for f in self.features})
        scored = self.pipeline.transform(filled)
        return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


Model = FittedModel | ExtraTrees | Bagged | Boosted


def boosting(kind: str, trees: int | None = None, depth: int | None = None) -> Settings:
    """``boosted`` has no weights and may end early; ``sampled`` draws rows and features for each tree and weighs the classes."""
    base = {"boosted": PLAIN, "sampled": DRAWN}[kind]
    return replace(base, rounds=trees or base.rounds, depth=depth or base.depth)


OVER_BINS = ("extra", "bagged", "boosted", "sampled")


def fit_model(df: DataFrame, features: list[str], kind: str, *, label: str = "label", pca: bool = False, **kw) -> Model:
    """Median imputation, scaling and optional components for linear models, balanced weights, classifier.

    The kinds of ``OVER_BINS`` are fitted on the table of bins and need ``pixel_id``: extremely randomised, bagged and
    two kinds of boosted trees, on all rows unless ``limit`` is given. All other kinds are Spark ML pipelines.
    """
    if kind == "extra":
        return ExtraTrees.fit(df, features, label=label, **kw)
    if kind == "bagged":
        return Bagged.fit(df, features, label=label, **kw)
    if kind in OVER_BINS:
        limit = kw.pop("limit", None)
        return Boosted.fit(df, features, boosting(kind, **kw), label=label, limit=limit)
    rows = df.where(F.col(label).isNotNull()).select(*features, F.col(label).alias("label")).cache()
    try:
        medians = fit_medians(rows, features)
        features = with_values(features, medians)
        ready = with_balance(rows.select(*[F.coalesce(F.col(f), F.lit(medians[f])).alias(f"_f_{f}") for f in features], "label"))
        scaled = pca or kind == "linear"
        stages = [VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="_v0" if scaled else "features")]
        if scaled:
            stages.append(StandardScaler(inputCol="_v0", outputCol="_v1" if pca else "features", withMean=True, withStd=True))
        if pca:
            head = Pipeline(stages=stages).fit(ready)
            k = components_for(head.transform(ready), "_v1", len(features))
            stages = [*head.stages, PCA(k=k, inputCol="_v1", outputCol="features")]
        stages.append(classifier(kind, **kw))
        pipeline = Pipeline(stages=stages).fit(ready)
        if kind == "linear":
            require_converged(pipeline.stages[-1])
    finally:
        rows.unpersist()
    return FittedModel(features, medians, pipeline)


class StackedModel:
    """Base models whose scores feed a logistic model."""

    def __init__(self, bases: dict[str, Model], meta: FittedModel):
        self.bases, self.meta = bases, meta

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        scored = df
        for name, model in self.bases.items():
            scored = model.predict(scored, f"_s_{name}")
        return self.meta.predict(scored, out).drop(*[f"_s_{n}" for n in self.bases])


def fits_over_bins(df: DataFrame, features: list[str], kinds: list[str], folds: list[int], trees: int | None = None, depth: int | None = None) -> dict:
    """One model for each (kind, fold left out), all on one table of bins made from the rows of the fit; ``df`` carries ``fold``.

    The bins follow the features of all folds, never a label. Kinds over all folds are fitted side by side.
    """
    rows = draw_rows(df, features, fold="fold")
    bins = Bins.fit(rows, features)
    table, out = binned(rows, bins), {}
    boosts = [(kind, fold) for kind in kinds if kind in ("boosted", "sampled") for fold in folds]
    if boosts:
        out |= zip(boosts, Boosted.fit_all(table, bins, [(boosting(kind, trees, depth), fold) for kind, fold in boosts]), strict=True)
    if "bagged" in kinds:
        sizes = {k: v for k, v in (("trees", trees), ("depth", depth)) if v}
        out |= zip([("bagged", fold) for fold in folds], Bagged.fit_all(table, bins, tuple(folds), **sizes), strict=True)
    if "extra" in kinds:
        n, deep = trees or extra.TREES, depth or extra.DEEPEST
        for fold in folds:
            mine = table if fold == EVERY_FOLD else table.where(F.col("fold") != fold)
            weights = extra.class_weights(mine)
            out["extra", fold] = ExtraTrees(bins, extra.grow_any(mine, bins, weights, n, deep), n, weights)
    return out


def fit_stack(df: DataFrame, features: list[str], kinds: list[str], *, folds: int = 5, block: str = "block_id", **kw) -> StackedModel:
    """Out-of-fold scores by grouped folds train the meta-model; base models are then refitted on all rows."""
    rows = materialise(group_folds(df.where("label IS NOT NULL"), folds, block))
    used = sorted(r[0] for r in rows.select("fold").distinct().collect())
    models = fits_over_bins(rows, features, kinds, [EVERY_FOLD, *used], **kw) if any(k in OVER_BINS for k in kinds) else {}
    for kind in kinds:
        if kind not in OVER_BINS:
            models |= {(kind, f): fit_model(rows.where(F.col("fold") != f), features, kind, **kw) for f in (EVERY_FOLD, *used)}
    parts = []
    for fold in used:
        held = rows.where(F.col("fold") == fold)
        for kind in kinds:
            held = models[kind, fold].predict(held, f"_s_{kind}")
        parts.append(held)
    out_of_fold = materialise(reduce(DataFrame.unionByName, parts))
    meta = fit_model(out_of_fold, [f"_s_{k}" for k in kinds], "linear", balanced=False)
    return StackedModel({k: models[k, EVERY_FOLD] for k in kinds}, meta)


def fit_domain(df: DataFrame, target: str, domain: str, features: list[str], kinds: list[str], *, missing_limit: float = 0.4,
               test: float = 0.2, id_col: str = "pixel_id", **kw) -> dict:
    """Label, block holdout, missingness filter, all models on the training side, refit of the best on all rows.

    ``kinds`` may hold ``stack``: a stack of all the other kinds, which is refitted as a stack if it is the best.
    """
    rows = df.where(F.col("domain") == domain).withColumn("label", extreme_label(target)).where("label IS NOT NULL")
    split = materialise(spread(blocked_holdout(rows, test=test), id_col))
    used = [r["feature"] for r in missingness(split.where("split = 'train'"), features, missing_limit).collect()]
    used = [f for f in features if f in used]
    bases = [k for k in kinds if k != "stack"]

    def fitted(frame: DataFrame, kind: str):
        return fit_stack(frame, used, bases, **kw) if kind == "stack" else fit_model(frame, used, kind, **kw)

    scored = split.where("split = 'test'")
    for kind in kinds:
        scored = fitted(split.where("split = 'train'"), kind).predict(scored, kind)
    long = scored.unpivot([id_col, "domain", "label"], kinds, "method", "score")
    metrics = binary_metrics(long, by=["method"])
    best = metrics.orderBy(F.desc("average_precision"), "method").first()["method"]
    final = fitted(split, best)
    return {"model": final, "best": best, "features": used, "metrics": metrics, "predictions": scored}


def score_cells(df: DataFrame, models: dict[str, Model], mode: str, keep: list[str]) -> DataFrame:
    """Scores for every cell: ``own`` (each row by its domain's model), ``single`` (one model over its
    domain) or ``all`` (every model over everything, one column each)."""
    if mode == "all":
        out = df
        for domain, model in models.items():
            out = model.predict(out, f"prob_{domain}")
        return out.select(*keep, *[f"prob_{d}" for d in models])
    parts = [m.predict(df.where(F.col("domain") == d), "prob").select(*keep, "domain", "prob") for d, m in models.items()]
    return reduce(DataFrame.unionByName, parts) if mode == "own" else parts[0]


def logit(c: str):
    p = F.least(F.greatest(F.col(c), F.lit(EPS)), F.lit(1 - EPS))
    return F.log(p / (F.lit(1.0) - p))


def fuse_scores(df: DataFrame, calibration: DataFrame, a: str = "pf_expert", b: str = "npf_expert", fit: bool = True) -> DataFrame:
    """Fused scores of two experts: larger score, larger rank against the calibration rows, and
    logistic models on the two logits and on the larger rank fitted on the calibration rows."""
    def ranked(rows: DataFrame) -> DataFrame:
        out = rows
        for c in (a, b):
            out = reference_rank(out, c, calibration, c, f"_rank_{c}")
        return out.withColumn("dual_max", F.greatest(a, b)).withColumn(
            "dual_rank_raw", F.greatest(f"_rank_{a}", f"_rank_{b}")).drop(f"_rank_{a}", f"_rank_{b}")

    out = ranked(df)
    if not fit:
        return out

    def features(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_la", logit(a)).withColumn("_lb", logit(b))

    base = features(ranked(calibration))
    dual = fit_model(base, ["_la", "_lb"], "linear", balanced=False)
    rank = fit_model(base, ["dual_rank_raw"], "linear", balanced=False)
    return rank.predict(dual.predict(features(out), "dual_expert"), "dual_rank").drop("_la", "_lb")


def fit_regressor(df: DataFrame, features: list[str], target: str, trees: int = 800, depth: int = MAX_DEPTH, seed: int = 42):
    """Tree regressor with median imputation: fitted pipeline, medians and impurity importances."""
    rows = df.where(F.col(target).isNotNull())
    medians = fit_medians(rows, features)
    features = with_values(features, medians)
    ready = rows.select(*[F.coalesce(F.col(f), F.lit(medians[f])).alias(f"_f_{f}") for f in features], F.col(target).alias("label"))
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="features"),
        RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.8",
                              minInstancesPerNode=2, seed=seed)]).fit(ready)
    importance = dict(zip(features, pipeline.stages[-1].featureImportances.toArray().tolist(), strict=True))

    def predict(frame: DataFrame, out: str = "prediction") -> DataFrame:
        filled = frame.withColumns({f"_f_{f}": F.coalesce(F.col(f), F.lit(medians[f])) for f in features})
        scored = pipeline.transform(filled).withColumnRenamed("prediction", "_raw")
        return scored.select(*frame.columns, F.col("_raw").alias(out))

    return predict, importance


def threshold_sweep(df: DataFrame, target: str, qs: list[float], features: list[str], kind: str, **kw) -> DataFrame:
    """One split of the blocks; at each quantile of the target relabel, refit on the training blocks, score the held-out ones."""
    limits = exact_quantiles(df, target, qs).first()["quantiles"]
    rows = df.where(F.col(target).isNotNull())
    split = materialise(spread(blocked_holdout(rows.withColumn("label", (F.col(target) >= limits[0]).cast("int")), test=0.25)))
    parts = []
    for q, limit in zip(qs, limits, strict=True):
        labelled = split.withColumn("label", (F.col(target) >= limit).cast("int"))
        model = fit_model(labelled.where("split = 'train'"), features, kind, **kw)
        metrics = binary_metrics(model.predict(labelled.where("split = 'test'")), score="prediction")
        parts.append(metrics.select(F.lit(q).alias("q"), F.lit(limit).alias("threshold"), "n", F.col("positive_fraction").alias("prevalence"),
                                    "roc_auc", "average_precision", "brier"))
    return reduce(DataFrame.unionByName, parts)


def ablation(df: DataFrame, variants: dict[str, list[str]], fit: Callable[[DataFrame, list[str]], object]) -> DataFrame:
    """Held-out metrics of one model per feature list; ``df`` carries label and split."""
    parts = []
    for name, features in variants.items():
        model = fit(df.where("split = 'train'"), features)
        metrics = binary_metrics(model.predict(df.where("split = 'test'")), score="prediction")
        parts.append(metrics.select(F.lit(name).alias("variant"), F.lit(len(features)).alias("n_features"), "n", "roc_auc", "average_precision", "brier"))
    return reduce(DataFrame.unionByName, parts)


def buffer_sweep(df: DataFrame, buffers: list[float], features: list[str], kind: str, ale_feature: str, *, distance: str = "boundary_distance_km",
                 min_rows: int = 1000, missing_limit: float = 0.4, **kw) -> DataFrame:
    """Refit on the rows at least each distance from the boundary, on the features that have enough values there.

    Buffers with too few rows, without a split that has both classes on both sides, or without features are reported as skipped.
    """
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(distance) >= b).alias(f"b{i}") for i, b in enumerate(buffers)]).first()
    parts = []

    def skipped(b: float, kept: int, share: float) -> DataFrame:
        return small_table(
            df.sparkSession, "buffer_km double, n_rows bigint, retained_frac double, status string, roc_auc double, average_precision double, brier double,"
            " ale_span double", [(b, kept, share, "skipped", None, None, None, None)])

    for i, b in enumerate(buffers):
        kept, share = counts[f"b{i}"], counts[f"b{i}"] / max(counts["n"], 1)
        if kept < min_rows:
            parts.append(skipped(b, kept, share))
            continue
        try:
            rows = materialise(spread(blocked_holdout(df.where(F.col(distance) >= b), test=0.25)))
            train = rows.where("split = 'train'")
            found = {r["feature"] for r in missingness(train, features, missing_limit).collect()}
            model = fit_model(train, [f for f in features if f in found], kind, **kw)
        except NoFeatures:
            parts.append(skipped(b, kept, share))
            continue
        except (PySparkException, Py4JJavaError) as error:
            if "no valid blocked split" not in str(error):
                raise
            parts.append(skipped(b, kept, share))
            continue
        test = rows.where("split = 'test'")
        m = binary_metrics(model.predict(test), score="prediction").select("roc_auc", "average_precision", "brier")
        span = ale_curve(test, ale_feature, model.predict).agg((F.max("y") - F.min("y")).alias("s")).scalar()
        parts.append(m.select(F.lit(b).alias("buffer_km"), F.lit(kept).cast("long").alias("n_rows"), F.lit(share).alias("retained_frac"), F.lit("fitted").alias("status"),
                              "roc_auc", "average_precision", "brier", span.alias("ale_span")))
    return reduce(DataFrame.unionByName, parts)
