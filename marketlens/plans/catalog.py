"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` each.

Every query reads the driver's tables through the staging adapter, so its
work grows with them. Decimal results are cast to DOUBLE at the boundary
(the library operators themselves return exact DECIMALs), matching the
oracle SQL column for column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from marketlens.operators import (experiment, features, insights, marts, metrics, modelling, quality,
                                  rollup, snapshot, training)
from marketlens.session import scratch_path
from marketlens.operators.frames import attach_one_row
from marketlens.sources import io, manifest
from marketlens.sources.staging import read_table, staged
from marketlens.streaming import rollup_stream

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def decimals_to_double(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
        else F.col(f.name)
        for f in df.schema.fields])


def query(name: str):
    """Register ``fn(spark, sf_dir) -> DataFrame``; decimals leave as DOUBLE."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return decimals_to_double(fn(spark, sf_dir))
        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return run
    return deco


def _econ(spark, sf_dir):
    s = staged(spark, sf_dir)
    return marts.channel_economics(s["customers"], s["orders"], s["spend"])


def _ltv(spark, sf_dir):
    s = staged(spark, sf_dir)
    return marts.customer_ltv(s["customers"], s["orders"])


def _retention(spark, sf_dir):
    s = staged(spark, sf_dir)
    return marts.cohort_retention(s["customers"], s["orders"])


# ------------------------------------------------------------------ marts
@query("channel_economics")
def q_channel_economics(spark, sf_dir):
    """M1 channel unit economics by month."""
    return _econ(spark, sf_dir)


@query("customer_ltv")
def q_customer_ltv(spark, sf_dir):
    """M2 per-order LTV."""
    return _ltv(spark, sf_dir)


@query("cohort_retention")
def q_cohort_retention(spark, sf_dir):
    """M3 cohort retention."""
    return _retention(spark, sf_dir)


# --------------------------------------------------------------- insights
@query("channel_summary")
def q_channel_summary(spark, sf_dir):
    return insights.channel_summary(_econ(spark, sf_dir))


@query("ltv_curve")
def q_ltv_curve(spark, sf_dir):
    return insights.ltv_curve(_ltv(spark, sf_dir))


@query("retention_matrix")
def q_retention_matrix(spark, sf_dir):
    return insights.retention_matrix(_retention(spark, sf_dir))


@query("channel_romi_ranking")
def q_channel_romi_ranking(spark, sf_dir):
    return insights.channel_romi_ranking(insights.channel_summary(_econ(spark, sf_dir)))


@query("revenue_per_spend")
def q_revenue_per_spend(spark, sf_dir):
    return insights.revenue_per_spend(_econ(spark, sf_dir))


@query("first_order_payback")
def q_first_order_payback(spark, sf_dir):
    s = staged(spark, sf_dir)
    summary = insights.channel_summary(
        marts.channel_economics(s["customers"], s["orders"], s["spend"]))
    return insights.first_order_payback(s["orders"], s["customers"], summary)


@query("mean_retention_curve")
def q_mean_retention_curve(spark, sf_dir):
    return insights.mean_retention_curve(_retention(spark, sf_dir))


@query("steepest_retention_drop")
def q_steepest_retention_drop(spark, sf_dir):
    return insights.steepest_retention_drop(
        insights.mean_retention_curve(_retention(spark, sf_dir)))


@query("channel_spend_share")
def q_channel_spend_share(spark, sf_dir):
    return insights.channel_spend_share(insights.channel_summary(_econ(spark, sf_dir)))


# ----------------------------------------------------------------- roll-up
def _events(spark, sf_dir):
    s = staged(spark, sf_dir)
    return rollup.order_events(s["orders"], s["customers"])


def _stored_events(spark, sf_dir) -> str:
    """K5: write the denormalised events once into the shared scratch folder."""
    path = scratch_path(spark, "order_events")
    rollup.write_events(_events(spark, sf_dir), path)
    return path


def _loaded(spark, sf_dir) -> str:
    """K4: events and their partial states, published together."""
    s = staged(spark, sf_dir)
    root = scratch_path(spark, "rollup")
    rollup.load_events_and_rollup(s["orders"], s["customers"], root)
    return root


@query("order_events")
def q_order_events(spark, sf_dir):
    return _events(spark, sf_dir)


@query("orphan_orders")
def q_orphan_orders(spark, sf_dir):
    s = staged(spark, sf_dir)
    return rollup.orphan_orders(s["orders"], s["customers"])


@query("rollup_from_orders")
def q_rollup_from_orders(spark, sf_dir):
    s = staged(spark, sf_dir)
    return rollup.rollup_from_orders(s["orders"], s["customers"])


@query("rollup_from_events")
def q_rollup_from_events(spark, sf_dir):
    return rollup.rollup_from_events(rollup.read_events(spark, _stored_events(spark, sf_dir)))


@query("rollup_merged")
def q_rollup_merged(spark, sf_dir):
    return rollup.merge_states(rollup.read_load(spark, _loaded(spark, sf_dir))[1])


FILES_PER_BATCH = 32


def _streamed(spark, events: str, root: str, name: str) -> None:
    """Consume an events folder to its end, some files per batch."""
    rollup_stream.start_rollup_stream(spark, events, root, scratch_path(spark, "stream_checkpoint"), name,
                                      max_files_per_trigger=FILES_PER_BATCH).awaitTermination()


@query("rollup_streamed")
def q_rollup_streamed(spark, sf_dir):
    """The events folder is consumed as a stream, a few files per batch."""
    root = scratch_path(spark, "stream_states")
    _streamed(spark, _stored_events(spark, sf_dir), root, "orders")
    return rollup_stream.read_rollup(spark, root)


@query("rollup_consistency")
def q_rollup_consistency(spark, sf_dir):
    """R6 after upkeep: a first load, the last month as a second one, compacted; the same events as a stream."""
    s = staged(spark, sf_dir)
    root, streamed = scratch_path(spark, "rollup"), scratch_path(spark, "stream_states")
    first, second = _orders_before_last_month(s["orders"]), _orders_of_last_month(s["orders"])
    rollup.append_load(first, s["customers"], root, "orders", 1)
    rollup.append_load(second, s["customers"], root, "orders", 2)
    rollup.append_load(second, s["customers"], root, "orders", 2)  # replayed: changes nothing
    rollup.compact(spark, root)
    events, states = rollup.read_load(spark, root)
    for n, folder in enumerate(manifest.current(spark, root).folders[rollup.EVENTS]):
        _streamed(spark, folder, streamed, f"load-{n}")
    return rollup.rollup_consistency({
        "orders": rollup.rollup_from_orders(s["orders"], s["customers"]),
        "events": rollup.rollup_from_events(events),
        "merged": rollup.merge_states(states),
        "streamed": rollup_stream.read_rollup(spark, streamed),
    })


def round_doubles(df: DataFrame, digits: int = 9) -> DataFrame:
    """Presentation rounding for statistics computed with exp/sqrt."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double"
        else F.col(f.name) for f in df.schema.fields])


# --------------------------------------------------------------- snapshots
MART_KEYS = {
    "channel_economics": ["channel", "spend_month"],
    "customer_ltv": ["order_id"],
    "cohort_retention": ["cohort_month", "month_number"],
}


@query("snapshot_key_check")
def q_snapshot_key_check(spark, sf_dir):
    """V1/V2/V3/V5: refresh all three mart snapshots, report their key checks."""
    s = staged(spark, sf_dir)
    built = {
        "channel_economics": marts.channel_economics(s["customers"], s["orders"], s["spend"]),
        "customer_ltv": marts.customer_ltv(s["customers"], s["orders"]),
        "cohort_retention": marts.cohort_retention(s["customers"], s["orders"]),
    }
    root = scratch_path(spark, "snapshots")
    snapshot.refresh_all({n: (df, MART_KEYS[n]) for n, df in built.items()}, root)
    parts = [snapshot.key_violations(snapshot.read_current(spark, f"{root}/{n}"), MART_KEYS[n])
             .select(F.lit(n).alias("mart"), "*") for n in built]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _orders_before_last_month(orders: DataFrame) -> DataFrame:
    """The orders as they stood before the latest month was loaded."""
    last = orders.agg(F.trunc(F.max("order_date"), "MM").alias("_load_month"))
    return (attach_one_row(orders, last)
            .where(F.col("order_date") < F.col("_load_month")).drop("_load_month"))


def _orders_of_last_month(orders: DataFrame) -> DataFrame:
    last = orders.agg(F.trunc(F.max("order_date"), "MM").alias("_load_month"))
    return (attach_one_row(orders, last)
            .where(F.col("order_date") >= F.col("_load_month")).drop("_load_month"))


@query("snapshot_diff")
def q_snapshot_diff(spark, sf_dir):
    """V4: LTV snapshot before vs after the latest month's orders arrived."""
    s = staged(spark, sf_dir)
    root = scratch_path(spark, "ltv_snapshots")
    old = snapshot.materialise(
        marts.customer_ltv(s["customers"], _orders_before_last_month(s["orders"])), root, ["order_id"])
    new = snapshot.materialise(marts.customer_ltv(s["customers"], s["orders"]), root, ["order_id"])
    return snapshot.snapshot_diff(snapshot.read_version(spark, root, old),
                                  snapshot.read_version(spark, root, new), ["order_id"])


# ------------------------------------------------------------- experiment
EXPERIMENT = "email_reactivation"
EXPERIMENT_SALT = "email-reactivation-2025"
SENT_AT = "1998-06-01"
# A customer dump of this day doesn't know who signed up later.
DUMP_DAY = "1997-01-01"


def _experiment(spark, sf_dir):
    s = staged(spark, sf_dir)
    assigned = experiment.assign(s["customers"], EXPERIMENT_SALT, experiment=EXPERIMENT)
    return experiment.attribute_conversions(assigned, s["orders"], SENT_AT)


@query("quality_report")
def q_quality_report(spark, sf_dir):
    s = staged(spark, sf_dir)
    return quality.check_experiment(_experiment(spark, sf_dir), s["customers"])


@query("experiment_assignment")
def q_experiment_assignment(spark, sf_dir):
    s = staged(spark, sf_dir)
    return experiment.assign(s["customers"], EXPERIMENT_SALT, experiment=EXPERIMENT)


@query("experiment_conversion")
def q_experiment_conversion(spark, sf_dir):
    return _experiment(spark, sf_dir)


@query("experiment_arms")
def q_experiment_arms(spark, sf_dir):
    return experiment.arm_summary(_experiment(spark, sf_dir), ["experiment"])


@query("experiment_report")
def q_experiment_report(spark, sf_dir):
    """X10 for the whole experiment and for every channel segment at once."""
    s = staged(spark, sf_dir)
    tagged = _experiment(spark, sf_dir).join(
        s["customers"].select("customer_id", F.col("channel").alias("segment")), "customer_id")
    # Each row counts towards its channel and towards the whole: one pass, and the
    # aggregation still combines map-side. The level keeps a channel of any name, or
    # without one, apart from the whole.
    both = tagged.withColumn("level", F.explode(F.array(F.lit("channel"), F.lit("experiment")))) \
        .withColumn("segment", F.when(F.col("level") == "channel", F.col("segment")))
    return round_doubles(experiment.analyse(experiment.arm_counts(both, ["experiment", "level", "segment"])))


@query("experiment_stored")
def q_experiment_stored(spark, sf_dir):
    """Early customers are enrolled and stored, the others added later; the stored table is read and analysed."""
    s = staged(spark, sf_dir)
    root = scratch_path(spark, "experiment")
    experiment.enrol(s["customers"].where(F.col("signup_date") < F.lit(DUMP_DAY).cast("date")), s["orders"], root,
                     EXPERIMENT_SALT, SENT_AT)
    experiment.enrol(s["customers"], s["orders"], root, EXPERIMENT_SALT, SENT_AT)
    stored = experiment.read_experiment(spark, root).withColumn("experiment", F.lit(EXPERIMENT))
    return round_doubles(experiment.analyse(experiment.arm_counts(stored, ["experiment"])))


@query("experiment_stored_arms")
def q_experiment_stored_arms(spark, sf_dir):
    """Every customer's arm after the second enrolment."""
    s = staged(spark, sf_dir)
    root = scratch_path(spark, "experiment")
    for part in (s["customers"].where(F.col("signup_date") < F.lit(DUMP_DAY).cast("date")), s["customers"]):
        experiment.enrol(part, s["orders"], root, EXPERIMENT_SALT, SENT_AT)
    return experiment.read_experiment(spark, root)


AA_SALT = "aa-calibration"
AA_REPLICATES = 200
REPLICATE = ["channel", "cohort"]


def _replicates(spark, sf_dir):
    """The experiment's rows with their natural replicates: channel and sign-up month."""
    s = staged(spark, sf_dir)
    who = s["customers"].select("customer_id", "channel", F.trunc("signup_date", "MM").alias("cohort"))
    return _experiment(spark, sf_dir).join(who, "customer_id")


@query("replicate_rejection_rate")
def q_replicate_rejection_rate(spark, sf_dir):
    """X11: A/A calibration, the rejection rate over random splits of all customers' real outcomes."""
    splits = experiment.aa_replicates(_experiment(spark, sf_dir), AA_REPLICATES, AA_SALT)
    return round_doubles(experiment.rejection_rate(splits, ["replicate"]))


@query("power_comparison")
def q_power_comparison(spark, sf_dir):
    return round_doubles(experiment.power_comparison(_replicates(spark, sf_dir), REPLICATE))


# ------------------------------------------------------------------ checks
def _customer_dump(customers: DataFrame) -> DataFrame:
    return customers.where(F.col("signup_date") < F.lit(DUMP_DAY).cast("date"))


@query("late_customer_orders")
def q_late_customer_orders(spark, sf_dir):
    """J7 against an older customer dump: the orders that it would drop."""
    s = staged(spark, sf_dir)
    return rollup.orphan_orders(s["orders"], _customer_dump(s["customers"]))


@query("quality_report_events")
def q_quality_report_events(spark, sf_dir):
    """Q1-Q5 on a raw table: event log rows in the experiment's columns, checked against an older customer dump.

    Errors have no customer and no arm, sign-ups no sending day, views no outcome yet; other
    event types than views and clicks are no arm of the experiment.
    """
    s = staged(spark, sf_dir)
    kind = F.col("event_type")
    raw = read_table(spark, sf_dir, "events").select(
        F.when(kind != "error", F.col("user_id")).alias("customer_id"),
        F.when(kind == "view", "control").when(kind == "click", "treatment").when(kind != "error", kind).alias("variant"),
        F.when(kind != "signup", F.col("ts").cast("date")).alias("sent_at"),
        F.when(kind != "view", F.col("value") > 50).alias("converted"))
    return quality.check_experiment(raw, _customer_dump(s["customers"]))


# ----------------------------------------------------------------- exports
def _marts(spark, sf_dir):
    s = staged(spark, sf_dir)
    return {
        "channel_economics": marts.channel_economics(s["customers"], s["orders"], s["spend"]),
        "customer_ltv": marts.customer_ltv(s["customers"], s["orders"]),
        "cohort_retention": marts.cohort_retention(s["customers"], s["orders"]),
    }


@query("export_round_trip")
def q_export_round_trip(spark, sf_dir):
    """Marts as CSV, features as Parquet and CSV, read back by schema and compared row by row.

    Marts and features are built once and stored; the exports and the comparisons read these.
    """
    root = scratch_path(spark, "exports")
    built = {n: training.store(df, f"{root}/built/{n}") for n, df in _marts(spark, sf_dir).items()}
    io.export_marts(built, root, single_file_for={"channel_economics", "cohort_retention"})
    gaps = {n: io.round_trip_gaps(df, io.read_csv(spark, f"{root}/{n}", df.schema)) for n, df in built.items()}
    feats = training.store(_features(spark, sf_dir).select(*io.FEATURES_SCHEMA.fieldNames()), f"{root}/built/features")
    io.write_features(feats, f"{root}/features", csv_path=f"{root}/features_csv")
    gaps["features"] = io.round_trip_gaps(feats, io.read_features(spark, f"{root}/features"))
    gaps["features_csv"] = io.round_trip_gaps(feats, io.read_features_csv(spark, f"{root}/features_csv"))
    parts = [df.select(F.lit(n).alias("export"), "rows", "lost", "changed") for n, df in gaps.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("mart_views")
def q_mart_views(spark, sf_dir):
    """K6: the marts as named views, asked in SQL."""
    io.register_views({f"mart_{n}": df for n, df in _marts(spark, sf_dir).items()})
    return spark.sql("""
        SELECT e.channel, COUNT(*) AS months, SUM(e.spend) AS spend, MAX(l.orders) AS orders, MAX(l.revenue) AS revenue
        FROM mart_channel_economics e
        JOIN (SELECT channel, COUNT(*) AS orders, SUM(total_amount) AS revenue FROM mart_customer_ltv GROUP BY channel) l
          ON l.channel = e.channel
        GROUP BY e.channel""")


# ---------------------------------------------------------- ordered output
@query("retention_in_order")
def q_retention_in_order(spark, sf_dir):
    """O1: cohort retention with its presentation position."""
    return insights.positioned(_retention(spark, sf_dir), "cohort_retention")


@query("ltv_curve_in_order")
def q_ltv_curve_in_order(spark, sf_dir):
    """O3: the LTV curve with its presentation position."""
    return insights.positioned(insights.ltv_curve(_ltv(spark, sf_dir)), "ltv_curve")


# ---------------------------------------------------------------- features
def _features(spark, sf_dir):
    s = staged(spark, sf_dir)
    return features.build_customer_features(s["customers"], s["orders"])


@query("churn_features")
def q_churn_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query("churn_summary")
def q_churn_summary(spark, sf_dir):
    return features.churn_summary(_features(spark, sf_dir))


@query("censoring_check")
def q_censoring_check(spark, sf_dir):
    s = staged(spark, sf_dir)
    return features.censoring_check(s["customers"], s["orders"])


# --------------------------------------------------------------- modelling
SPLIT_SALT = "split"


def _split(spark, sf_dir):
    return modelling.stratified_split(_features(spark, sf_dir), salt=SPLIT_SALT)


def _train(spark, sf_dir):
    return _split(spark, sf_dir).where(F.col("split") == "train")


def reference_scores(df: DataFrame) -> DataFrame:
    """A deterministic churn score for metric checks: fewer orders, higher
    score; predicted churned at 9 orders or fewer."""
    s = F.lit(1.0) / (F.lit(1) + F.col("total_orders"))
    return df.select(F.col("customer_id").alias("id"), F.col("churned").cast("int").alias("label"),
                     s.alias("score"), (s >= 0.1).cast("int").alias("prediction"))


def _scored(spark, sf_dir):
    return reference_scores(_split(spark, sf_dir).where(F.col("split") == "test"))


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("customer_id", "churned", "split")


@query("class_weights")
def q_class_weights(spark, sf_dir):
    return modelling.class_weights(_train(spark, sf_dir))


@query("scaled_features")
def q_scaled_features(spark, sf_dir):
    split = _stored_split(spark, sf_dir)
    stats = modelling.fit_standardizer(split.where(F.col("split") == "train"))
    scaled = modelling.apply_standardizer(split, stats)
    return round_doubles(scaled.select(
        "customer_id", *[f"{c}_scaled" for c in modelling.NUMERIC_FEATURES]), 6)


@query("one_hot_channel")
def q_one_hot_channel(spark, sf_dir):
    split = _stored_split(spark, sf_dir)
    model = modelling.fit_one_hot(split.where(F.col("split") == "train"))
    return modelling.one_hot_positions(model, split.select("customer_id", "channel"))


@query("roc_auc")
def q_roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scored(spark, sf_dir))


@query("average_precision")
def q_average_precision(spark, sf_dir):
    return round_doubles(metrics.average_precision(_scored(spark, sf_dir)))


@query("roc_curve")
def q_roc_curve(spark, sf_dir):
    return metrics.roc_curve(_scored(spark, sf_dir))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir))


@query("classification_report")
def q_classification_report(spark, sf_dir):
    return metrics.classification_report(_scored(spark, sf_dir))


@query("accuracy")
def q_accuracy(spark, sf_dir):
    return metrics.accuracy(_scored(spark, sf_dir))


def _stored_split(spark, sf_dir):
    """The features with their split, built once and stored."""
    return training.store(_split(spark, sf_dir), scratch_path(spark, "split"))


def _prepared(spark, sf_dir):
    split = _stored_split(spark, sf_dir)
    train, others = modelling.prepare(split.where(F.col("split") == "train"),
                                      {"test": split.where(F.col("split") == "test")})
    return train, others["test"]


@query("logistic_scores")
def q_logistic_scores(spark, sf_dir):
    """Balanced logistic regression scores on the test split."""
    train, test = _prepared(spark, sf_dir)
    return modelling.score(modelling.fit_logistic(train), test)


@query("logistic_audit")
def q_logistic_audit(spark, sf_dir):
    """The fitted optimum's gradient, and the scores by rule; zeros besides the row count."""
    train, test = _prepared(spark, sf_dir)
    return training.logistic_audit(modelling.fit_logistic(train), train, test)


@query("forest_importance")
def q_forest_importance(spark, sf_dir):
    """Random forest (300 trees, seed 42) feature importances."""
    train, _ = _prepared(spark, sf_dir)
    return modelling.importance(modelling.fit_forest(train))


@query("forest_audit")
def q_forest_audit(spark, sf_dir):
    """Importances and test scores recomputed from the stored node table; zeros besides the row count."""
    train, test = _prepared(spark, sf_dir)
    return training.forest_audit(modelling.fit_forest(train), test, scratch_path(spark, "forest"))


@query("model_runs")
def q_model_runs(spark, sf_dir):
    """Train, evaluate and record both models from one stored split; the runs with their audit."""
    root = scratch_path(spark, "training")
    scored = training.train_and_record(_features(spark, sf_dir), root)
    return training.run_audit(scored, training.read_runs(spark, root))


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)
