"""Train, evaluate and record, from one stored split.

The features are built and split once, and stored; both models are prepared,
fitted and scored from that copy, their test scores are stored too, and every
metric reads those. A run is one row of the append-only runs table.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import metrics, modelling

LOGISTIC, FOREST = "Logistic Regression", "Random Forest"


def store(df: DataFrame, path: str) -> DataFrame:
    """Write once; what is read back no longer knows how it was built."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fitted_models(train: DataFrame, forest: dict | None = None) -> dict[str, PipelineModel]:
    return {LOGISTIC: modelling.fit_logistic(train), FOREST: modelling.fit_forest(train, **(forest or {}))}


def train_and_record(features: DataFrame, root: str, forest: dict | None = None) -> dict[str, DataFrame]:
    """Fit both models on ``features``; per model, the stored test scores.

    Under ``root``: ``split`` (the features with their split), ``scores/<n>``
    and ``runs`` (one row per model, appended).
    """
    split = store(modelling.stratified_split(features), f"{root}/split")
    train, others = modelling.prepare(split.where("split = 'train'"), {"test": split.where("split = 'test'")})
    scored = {}
    for n, (name, model) in enumerate(fitted_models(train, forest).items()):
        scored[name] = store(modelling.score(model, others["test"]), f"{root}/scores/{n}")
        found = evaluate(scored[name]).first()
        trees = model.stages[-1].getNumTrees if name == FOREST else None
        modelling.log_run(f"{root}/runs", name, found["roc_auc"], found["pr_auc"], found["accuracy"], n_estimators=trees)
    return scored


def evaluate(scored: DataFrame) -> DataFrame:
    """One row: roc_auc, pr_auc (average precision), accuracy."""
    from marketlens.operators.frames import attach_one_row
    both = attach_one_row(metrics.roc_auc(scored), metrics.average_precision(scored).withColumnRenamed("average_precision", "pr_auc"))
    return attach_one_row(both, metrics.accuracy(scored))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(modelling.RUNS_SCHEMA).parquet(f"{root}/runs")


def evaluator_gaps(scored: DataFrame) -> tuple[float, float]:
    """Spark ML's own area under the ROC curve and accuracy of the same scores."""
    df = scored.select(F.col("label").cast("double").alias("label"), "score", F.col("prediction").cast("double").alias("prediction"))
    auc = BinaryClassificationEvaluator(rawPredictionCol="score", metricName="areaUnderROC", numBins=0).evaluate(df)
    return auc, MulticlassClassificationEvaluator(metricName="accuracy").evaluate(df)


def run_audit(scored: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    """Per recorded run: its parameters, the rows it was tested on, and how far the recorded metrics are from
    Spark ML's evaluators over the same stored scores (0 when they agree)."""
    rows = []
    for name, df in scored.items():
        auc, accuracy = evaluator_gaps(df)
        n, positives = df.agg(F.count(F.lit(1)), F.sum("label")).first()
        rows.append((name, int(n), int(positives or 0), auc, accuracy))
    checked = runs.sparkSession.createDataFrame(rows, "model string, test_rows long, test_positives long, auc double, acc double")
    return runs.join(F.broadcast(checked), "model").select(  # a row per model
        "model", "random_state", "n_estimators", "test_rows", "test_positives",
        (F.round(F.abs(F.col("roc_auc") - F.col("auc")), 9)).alias("roc_auc_gap"),
        (F.round(F.abs(F.col("accuracy") - F.col("acc")), 9)).alias("accuracy_gap"),
        F.col("pr_auc").between(0, 1).alias("pr_auc_in_range"))


def logistic_audit(model: PipelineModel, train: DataFrame, test: DataFrame) -> DataFrame:
    """(check, value), all but the row count 0 for a fitted optimum and scores that follow from it.

    ``gradient`` rows are the mean derivatives of the regularised objective by
    every coefficient (and the intercept), summed over the training rows from
    their fitted scores; they vanish at the optimum and nowhere else, the
    objective being strictly convex. The other rows count test scores that
    are no probabilities, don't equal the logistic function of the linear
    term, or disagree with their prediction.
    """
    lr = model.stages[-1]
    names = modelling.feature_names(model)
    fitted = model.transform(train)
    residual = F.col("weight") * (vector_to_array(F.col("probability"))[1] - F.col(modelling.LABEL))
    x = vector_to_array(F.col("features"))
    sums = fitted.select(residual.alias("r"), "weight", x.alias("x")).agg(
        F.sum("weight").alias("w"), F.sum("r").alias("g_intercept"),
        *[F.sum(F.col("r") * F.col("x")[j]).alias(f"g{j}") for j in range(len(names))])
    slopes = [float(v) for v in lr.coefficients.toArray()]
    zero = lambda c: F.round(c, 6) + F.lit(0.0)  # noqa: E731 - no negative zero
    rows = [F.struct(F.lit("gradient: intercept").alias("check"), zero(F.col("g_intercept") / F.col("w")).alias("value"))]
    # The penalty's share: weights sum to w, and regParam is 1 / (C w) with C = 1.
    rows += [F.struct(F.lit(f"gradient: {name}").alias("check"), zero((F.col(f"g{j}") + F.lit(slopes[j])) / F.col("w")).alias("value"))
             for j, name in enumerate(names)]
    gradient = sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    out = model.transform(test)
    p = vector_to_array(F.col("probability"))[1]
    linear = F.aggregate(F.zip_with(vector_to_array("features"), F.array(*[F.lit(v) for v in slopes]), lambda a, b: a * b),
                         F.lit(float(lr.intercept)), lambda s, v: s + v)
    wrong = lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0))
    counts = out.agg(
        F.count(F.lit(1)).cast("double").alias("test rows"),
        wrong(~((p > 0) & (p < 1))).alias("scores outside (0, 1)"),
        wrong(F.abs(p - F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))) > 1e-9).alias("scores off the logistic function"),
        wrong((p > 0.5) != (F.col("prediction") == 1)).alias("predictions against the threshold"))
    tall = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("value")) for c in counts.columns]))
                         .alias("r")).select("r.*")
    return gradient.unionByName(tall)


def forest_audit(model: PipelineModel, test: DataFrame, path: str) -> DataFrame:
    """(check, position, value), the stored node table against the model object.

    Per input, the difference of the importance recomputed from the nodes to
    the model's (0), at its position in the importance order; and the test
    rows whose score or prediction from the iterative join differs (0).
    """
    from marketlens.operators import trees
    forest, names = model.stages[-1], modelling.feature_names(model)
    nodes = trees.node_table(model, path)
    own = trees.node_importance(nodes, names)
    given = modelling.importance(model)
    gaps = (own.join(given.withColumnRenamed("importance", "given"), "feature")
            .select(F.concat(F.lit("importance: "), F.col("feature")).alias("check"),
                    F.round(F.abs(F.col("importance") - F.col("given")), 9).alias("value")))
    walked = trees.score_nodes(nodes, trees.model_inputs(model, test), forest.getNumTrees, forest.depth)
    scored = modelling.score(model, test)
    both = scored.select("id", F.col("score").alias("s"), F.col("prediction").alias("p")).join(walked, "id", "left")
    far = F.coalesce(F.abs(F.col("s") - F.col("score")) > 1e-9, F.lit(True))
    # Exactly even votes may round either way.
    other = F.coalesce((F.col("p") != F.col("prediction")) & (F.abs(F.col("score") - 0.5) > 1e-9), F.lit(True))
    counts = both.agg(F.count(F.lit(1)).cast("double").alias("test rows"), F.sum(far.cast("double")).alias("scores that differ"),
                      F.sum(other.cast("double")).alias("predictions that differ"))
    tall = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("value")) for c in counts.columns]))
                         .alias("r")).select("r.*")
    return gaps.unionByName(tall)
