"""Churn models.

Preparation is plain DataFrame work so it scales and stays checkable:
a hash-ordered stratified split (test rows apportioned by largest remainder, no single-task window),
balanced class weights from a per-class count, and standardisation with the
population standard deviation of the training split (one aggregation, joined
back as a one-row broadcast). The channel is one-hot encoded with Spark ML
(unseen categories encode as all zeros). Models are fitted on the cluster,
the logistic regression by ``pyspark.ml`` and the forest by ``forest``;
scoring returns (id, label, score, prediction) for the metrics module.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType,
                               TimestampType)

from marketlens.operators import forest
from marketlens.operators.features import assert_no_leakage
from marketlens.operators.frames import attach_one_row
from marketlens.operators.ranking import join_null_safe, rank_by_hash

# Fixed values of the model set-up.
NUMERIC_FEATURES = ["tenure_days", "total_orders", "total_revenue", "avg_order_value",
                    "first_order_gap_days", "order_frequency"]
CATEGORICAL_FEATURE = "channel"
LABEL = "churned"
TEST_FRACTION = 0.25
RANDOM_STATE = 42
N_TREES = 300
MAX_ITER = 1000
# The optimiser stops when the objective's relative change is below this.
TOLERANCE = 1e-10
# A tree's leaf holds at least this share of the weights, so that a tree has at most 10,000 leaves on any
# number of rows and the arrays to score with fit the driver; below 10,000 rows a leaf may hold a single one.
LEAF_SHARE = 1e-4

RUNS_SCHEMA = StructType([
    StructField("model", StringType(), False),
    StructField("random_state", LongType(), True),
    StructField("n_estimators", LongType(), True),
    StructField("roc_auc", DoubleType(), True),
    StructField("pr_auc", DoubleType(), True),
    StructField("accuracy", DoubleType(), True),
    StructField("logged_at", TimestampType(), False),
])


def class_quotas(df: DataFrame, label: str = LABEL, test_fraction: float = TEST_FRACTION) -> DataFrame:
    """(label, quota): the ceil(f * n) test rows apportioned to the classes by largest remainder.

    Every class gets the whole part of its share, and the rows that are left
    go to the largest fractions (equal ones: the smaller label). In integers,
    over one row per class.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    share = (counts.withColumn("_n", F.sum("_c").over(every))
             .withColumn("_test", F.ceil(F.lit(test_fraction) * F.col("_n")))
             .withColumn("_whole", F.expr("_test * _c div _n"))
             .withColumn("_rest", F.expr("_test * _c % _n"))
             .withColumn("_left", F.col("_test") - F.sum("_whole").over(every)))
    by_rest = Window.partitionBy(F.lit(0)).orderBy(F.col("_rest").desc(), F.col(label))
    extra = (F.row_number().over(by_rest) <= F.col("_left")).cast("long")
    return share.select(label, (F.col("_whole") + extra).alias("quota"))


def stratified_split(df: DataFrame, label: str = LABEL, test_fraction: float = TEST_FRACTION,
                     salt: str = "split", id_col: str = "customer_id") -> DataFrame:
    """L1: ``split`` = test for the first ``class_quotas`` rows of each class in
    ``md5(salt || id)`` order, train otherwise."""
    ranked = rank_by_hash(df, id_col, salt, by=[label], rank_col="_r")
    quotas = class_quotas(df, label, test_fraction)
    marked = join_null_safe(ranked, quotas, [label], broadcast=True)  # one row per class
    return marked.withColumn("split", F.when(F.col("_r") <= F.col("quota"), "test").otherwise("train")).drop("_r", "quota")


def class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """L2: balanced weights n / (k * n_c), one row per class."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("class_count"))
    totals = counts.agg(F.sum("class_count").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return attach_one_row(counts, totals).select(
        label, "class_count",
        (F.col("_n").cast("double") / (F.col("_k") * F.col("class_count")).cast("double"))
        .alias("weight"))


def with_weights(df: DataFrame, weights: DataFrame, label: str = LABEL) -> DataFrame:
    """Attach the class weight; the weights table has one row per class."""
    return join_null_safe(df, weights.select(label, "weight"), [label], broadcast=True)


def fit_standardizer(train: DataFrame, cols: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """L3 fit: one row of population means and standard deviations.

    Like any fitted model the parameters are a handful of numbers; they are
    collected once and returned as a one-row literal table, so applying them
    never re-runs the training aggregation.
    """
    row = train.agg(*[F.avg(c).alias(f"_mean_{c}") for c in cols],
                    *[F.stddev_pop(c).alias(f"_std_{c}") for c in cols]).first()
    schema = ", ".join(f"_mean_{c} double" for c in cols) + ", " + ", ".join(
        f"_std_{c} double" for c in cols)
    return train.sparkSession.createDataFrame([tuple(row)], schema)


def apply_standardizer(df: DataFrame, stats: DataFrame, cols: list[str] = NUMERIC_FEATURES,
                       suffix: str = "_scaled") -> DataFrame:
    """L3 transform: (x - mean) / std; a zero std leaves x - mean."""
    joined = attach_one_row(df, stats)
    scaled = []
    for c in cols:
        centred = F.col(c).cast("double") - F.col(f"_mean_{c}")
        std = F.col(f"_std_{c}")
        scaled.append(F.when(std > 0, centred / std).otherwise(centred).alias(f"{c}{suffix}"))
    return joined.select(*df.columns, *scaled)


def channel_encoder(col: str = CATEGORICAL_FEATURE) -> list:
    """L4: alphabetical index + one-hot; an unseen value encodes as all zeros."""
    return [StringIndexer(inputCol=col, outputCol=f"{col}_idx", handleInvalid="keep",
                          stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"{col}_idx"], outputCols=[f"{col}_vec"], dropLast=True)]


def fit_one_hot(train: DataFrame, col: str = CATEGORICAL_FEATURE) -> PipelineModel:
    return Pipeline(stages=channel_encoder(col)).fit(train)


def one_hot_positions(model: PipelineModel, df: DataFrame, col: str = CATEGORICAL_FEATURE) -> DataFrame:
    """The one-hot vector as (position of the 1 or NULL, vector size)."""
    enc = model.transform(df)
    arr = vector_to_array(F.col(f"{col}_vec"))
    pos = F.array_position(arr, F.lit(1.0))
    return enc.select(*df.columns,
                      F.when(pos > 0, pos - 1).cast("int").alias("onehot_index"),
                      F.size(arr).alias("onehot_size"))


def prepare(train: DataFrame, others: dict[str, DataFrame] | None = None,
            features: list[str] = NUMERIC_FEATURES, label: str = LABEL
            ) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Weights + scaling fitted on ``train``; applied to train and others.

    Class weights (one per class) are collected and attached as a literal
    CASE expression; no join back to the training rows is needed.
    """
    assert_no_leakage(features + [CATEGORICAL_FEATURE])
    stats = fit_standardizer(train, features)
    weights = {r[label]: r["weight"] for r in class_weights(train, label).collect()}
    weight = None
    for cls, w in weights.items():
        cond = F.col(label) == F.lit(cls)
        weight = F.when(cond, F.lit(w)) if weight is None else weight.when(cond, F.lit(w))
    prep_train = apply_standardizer(train, stats, features).withColumn("weight", weight)
    prepped = {k: apply_standardizer(v, stats, features) for k, v in (others or {}).items()}
    return prep_train, prepped


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"{c}_scaled" for c in features] + [f"{CATEGORICAL_FEATURE}_vec"],
                           outputCol="features")


# A fit's partitions: one for every 10,000 rows, up to 12 that a small cluster works on at once, and one for every 100,000
# rows of larger tables. The rows alone decide.
SMALL_PARTITION, SMALL_PARTITIONS = 10_000, 12
ROWS_PER_PARTITION = 100_000


def fit_partitions(rows: int) -> int:
    return max(1, min(SMALL_PARTITIONS, -(-rows // SMALL_PARTITION)), -(-rows // ROWS_PER_PARTITION))


def _fit(stages: list, train: DataFrame, rows: int) -> PipelineModel:
    """Fit with the training rows persisted and sized to their volume.

    Iterative learners pass over the rows many times: recomputing the
    feature plan on every pass would dominate, and so would per-task
    overhead if a small training set stayed spread over many partitions.
    The cache is released as soon as the fit returns.
    """
    cached = train.repartition(fit_partitions(int(rows))).persist()
    try:
        return Pipeline(stages=stages).fit(cached)
    finally:
        cached.unpersist()


def fit_logistic(train: DataFrame, features: list[str] = NUMERIC_FEATURES,
                 max_iter: int = MAX_ITER) -> PipelineModel:
    """Balanced L2 logistic regression (C = 1).

    With weights summing to n, scikit-learn's objective
    0.5||w||^2 + C·Σ w_i·loss_i equals Spark's (1/Σw)·Σ w_i·loss_i +
    (regParam/2)||w||^2 up to a constant factor when regParam = 1/(C·Σw).
    ``train`` must come from ``prepare`` (weight and *_scaled columns).
    """
    total_weight = train.agg(F.sum("weight")).first()[0]  # one scalar for regParam
    lr = LogisticRegression(featuresCol="features", labelCol=LABEL, weightCol="weight",
                            regParam=1.0 / float(total_weight), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=TOLERANCE)
    return _fit(channel_encoder() + [_assembler(features), lr], train, rows=int(total_weight))


def fit_forest(train: DataFrame, features: list[str] = NUMERIC_FEATURES, num_trees: int = N_TREES,
               seed: int = RANDOM_STATE, max_depth: int = 30, leaf_share: float = LEAF_SHARE) -> PipelineModel:
    """Balanced random forest (sqrt features per split, seeded); ``leaf_share`` bounds a tree's size."""
    encoders = Pipeline(stages=channel_encoder() + [_assembler(features)]).fit(train)
    rows = encoders.transform(train).select("features", F.col(LABEL).alias("label"), "weight",
                                            F.xxhash64(*train.columns).alias("key"))
    fitted = forest.fit(rows, num_trees, seed, max_depth, leaf_share, inputs=len(feature_names(encoders, features)), numeric=len(features))
    return PipelineModel(encoders.stages + [fitted])


def score(model: PipelineModel, df: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """(id, label, score = P(class 1), prediction)."""
    out = model.transform(df)
    return out.select(F.col(id_col).alias("id"), F.col(LABEL).cast("int").alias("label"),
                      vector_to_array(F.col("probability"))[1].alias("score"),
                      F.col("prediction").cast("int").alias("prediction"))


def feature_names(model: PipelineModel, features: list[str] = NUMERIC_FEATURES) -> list[str]:
    labels = model.stages[0].labels
    return list(features) + [f"{CATEGORICAL_FEATURE}_{v}" for v in labels]


def importance(model: PipelineModel, features: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """(feature, importance) ordered by importance, descending.

    Forest: impurity importances; logistic regression: coefficients on the
    standardised inputs. The table has one row per model input.
    """
    fitted = model.stages[-1]
    values = (fitted.featureImportances.toArray() if hasattr(fitted, "featureImportances")
              else fitted.coefficients.toArray())
    names = feature_names(model, features)
    rows = [(n, float(v)) for n, v in zip(names, values)]
    from pyspark.sql import SparkSession
    active = SparkSession.getActiveSession()
    return (active.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.col("importance").desc(), "feature"))


def log_run(runs_path: str, model: str, roc_auc: float | None, pr_auc: float | None,
            accuracy: float | None, n_estimators: int | None = None,
            random_state: int = RANDOM_STATE) -> None:
    """Append one run record to a Parquet runs table."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    row = (model, random_state, n_estimators, roc_auc, pr_auc, accuracy,
           dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    spark.createDataFrame([row], RUNS_SCHEMA).coalesce(1).write.mode("append").parquet(runs_path)
