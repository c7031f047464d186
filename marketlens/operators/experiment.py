"""Assign, attribute and analyse A/B experiments as DataFrames.

Statistics are columns over aggregated arm counts, so one plan analyses any
number of experiments and segments at once: the row-level work is a single
conditional aggregation (combined map-side), and the formulas run on one row
per (experiment, segment).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.stats import chi2_sf_df1, normal_cdf, normal_quantile, two_sided_p
from marketlens.operators.frames import attach_one_row
from marketlens.operators.ranking import hash_key, rank_by_hash
from marketlens.sources import manifest
from marketlens.sources.staging import EXPERIMENT

# Fixed values of the experiment design.
ALPHA = 0.05
TARGET_POWER = 0.80
SRM_ALPHA = 0.01
CONVERSION_WINDOW_DAYS = 14
CONTROL, TREATMENT = "control", "treatment"
VERDICT_SRM = "NO SHIP - SRM triggered"
VERDICT_SHIP = "SHIP - significant difference, SRM passed"
VERDICT_INCONCLUSIVE = "NO SHIP (inconclusive) - no significant difference"


def _div(a: Column, b: Column) -> Column:
    """Division that yields NULL instead of an error on a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


# ------------------------------------------------------------- assignment
def assign(customers: DataFrame, salt: str, experiment: str | None = None,
           id_col: str = "customer_id") -> DataFrame:
    """Seeded 50/50 split; control gets floor(n/2), treatment the rest.

    Customers are ordered by ``md5(salt || id)`` and ranked with the bucketed
    global rank (no single-task window); the first floor(n/2) are control.
    Each distinct id is assigned once (duplicates collapse map-side, so no
    repeated id can pile up in one hash bucket).
    """
    ids = customers.select(id_col).distinct()
    ranked = rank_by_hash(ids, id_col, salt, rank_col="_r", size_col="_n")
    out = ranked.select(
        id_col,
        F.when(F.col("_r") <= F.floor(F.col("_n") / 2), CONTROL).otherwise(TREATMENT)
        .alias("variant"))
    if experiment is not None:
        out = out.withColumn("experiment", F.lit(experiment))
    return out


def attribute_conversions(assigned: DataFrame, orders: DataFrame, sent_at: str,
                          window_days: int = CONVERSION_WINDOW_DAYS) -> DataFrame:
    """converted = an order in (sent_at, sent_at + window]; first such date.

    The send date is a literal, so the date window is pushed into the orders
    scan; qualifying orders are reduced to one row per customer (min date,
    combined map-side) before the left join back to the assignment.
    """
    start = F.lit(sent_at).cast("date")
    end = F.date_add(start, int(window_days))
    first = (orders.where((F.col("order_date") > start) & (F.col("order_date") <= end))
             .groupBy("customer_id").agg(F.min("order_date").alias("converted_at")))
    return (assigned.join(first, "customer_id", "left")
            .select(*assigned.columns, start.alias("sent_at"),
                    F.col("converted_at").isNotNull().alias("converted"),
                    "converted_at"))


# ---------------------------------------------------------------- summaries
def arm_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """X3 (long form): n, conversions and rate per variant within ``by``."""
    by = list(by or [])
    return (df.groupBy(*by, "variant")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.col("converted").cast("int")).cast("long").alias("conversions"))
            .withColumn("rate", _div(F.col("conversions"), F.col("n"))))


def arm_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """X3 (wide form): n/x for control and treatment in one pass per group."""
    by = list(by or [])
    is_c = F.col("variant") == CONTROL
    is_t = F.col("variant") == TREATMENT
    conv = F.col("converted").cast("boolean")
    return df.groupBy(*by).agg(
        F.sum(is_c.cast("int")).cast("long").alias("n_control"),
        F.sum((is_c & conv).cast("int")).cast("long").alias("x_control"),
        F.sum(is_t.cast("int")).cast("long").alias("n_treatment"),
        F.sum((is_t & conv).cast("int")).cast("long").alias("x_treatment"),
    )


# ----------------------------------------------------- statistics (columns)
def srm(n1: Column, n2: Column, expected_ratio: float = 0.5) -> tuple[Column, Column]:
    """Chi-square goodness of fit of the arm sizes; (chi2, p)."""
    total = (n1 + n2).cast("double")
    e1, e2 = total * expected_ratio, total * (1 - expected_ratio)
    chi2 = _div((n1 - e1) * (n1 - e1), e1) + _div((n2 - e2) * (n2 - e2), e2)
    return chi2, chi2_sf_df1(chi2)


def ztest(x1: Column, n1: Column, x2: Column, n2: Column) -> tuple[Column, Column]:
    """Pooled two-proportion z-test, two-sided; NULL when pooled rate is 0 or 1."""
    p1, p2 = _div(x1, n1), _div(x2, n2)
    pool = _div(x1 + x2, n1 + n2)
    se = F.sqrt(pool * (F.lit(1.0) - pool) * (_div(F.lit(1), n1) + _div(F.lit(1), n2)))
    z = F.when(se > 0, (p2 - p1) / se)
    return z, two_sided_p(z)


def diff_ci(x1: Column, n1: Column, x2: Column, n2: Column,
            confidence: float = 0.95) -> tuple[Column, Column, Column]:
    """Wald interval of p2 - p1 with the unpooled standard error."""
    p1, p2 = _div(x1, n1), _div(x2, n2)
    diff = p2 - p1
    se = F.sqrt(p1 * (F.lit(1.0) - p1) / n1 + p2 * (F.lit(1.0) - p2) / n2)
    z = normal_quantile(1 - (1 - confidence) / 2)
    return diff, diff - F.lit(z) * se, diff + F.lit(z) * se


def required_n(p1: Column, p2: Column, alpha: float = ALPHA, power: float = TARGET_POWER) -> Column:
    """Sample size per arm; NULL when p1 == p2 (no effect to detect)."""
    za, zb = normal_quantile(1 - alpha / 2), normal_quantile(power)
    num = F.lit((za + zb) ** 2) * (p1 * (F.lit(1.0) - p1) + p2 * (F.lit(1.0) - p2))
    den = (p2 - p1) * (p2 - p1)
    return F.when(den > 0, F.ceil(num / den)).cast("long")


def power_argument(p1: Column, p2: Column, n_per_arm: Column, alpha: float = ALPHA) -> Column:
    """X8's normal quantile: NULL when both rates are 0 or 1."""
    za = normal_quantile(1 - alpha / 2)
    p_bar = (p1 + p2) / 2
    se_alt = F.sqrt(p1 * (F.lit(1.0) - p1) + p2 * (F.lit(1.0) - p2))
    num = (F.abs(p2 - p1) * F.sqrt(n_per_arm.cast("double"))
           - F.lit(za) * F.sqrt(F.lit(2.0) * p_bar * (F.lit(1.0) - p_bar)))
    return F.when(se_alt > 0, num / se_alt)


def achieved_power(p1: Column, p2: Column, n_per_arm: Column, alpha: float = ALPHA) -> Column:
    """Normal-approximation power of the pooled test at ``n_per_arm``."""
    return normal_cdf(power_argument(p1, p2, n_per_arm, alpha))


def analyse(arms: DataFrame, alpha: float = ALPHA, power: float = TARGET_POWER,
            expected_ratio: float = 0.5, confidence: float = 0.95,
            srm_alpha: float = SRM_ALPHA) -> DataFrame:
    """The full report per row of wide arm counts (``arm_counts``).

    Computed in stages that reference earlier columns by name, so the normal
    CDF polynomial is applied to a column, not to an inlined copy of the
    whole z expression (keeps the plan and the generated code small).
    """
    n1, x1, n2, x2 = (F.col(c) for c in ("n_control", "x_control", "n_treatment", "x_treatment"))
    chi2, _ = srm(n1, n2, expected_ratio)
    z, _ = ztest(x1, n1, x2, n2)
    diff, lo, hi = diff_ci(x1, n1, x2, n2, confidence)
    stage1 = arms.select(
        "*",
        _div(x1, n1).alias("rate_control"), _div(x2, n2).alias("rate_treatment"),
        chi2.alias("srm_chi2"), z.alias("z"),
        diff.alias("diff"), lo.alias("ci_low"), hi.alias("ci_high"),
        power_argument(_div(x1, n1), _div(x2, n2), n1, alpha).alias("_power_arg"))
    p1, p2 = F.col("rate_control"), F.col("rate_treatment")
    stage2 = stage1.select(
        "*",
        chi2_sf_df1(F.col("srm_chi2")).alias("srm_p"),
        two_sided_p(F.col("z")).alias("p_value"),
        required_n(p1, p2, alpha, power).alias("required_n_per_arm"),
        normal_cdf(F.col("_power_arg")).alias("power_now")).drop("_power_arg")
    significant = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    stage3 = stage2.withColumn("significant", significant)
    verdict = (F.when(F.col("srm_p") < srm_alpha, VERDICT_SRM)
               .when(F.col("significant"), VERDICT_SHIP)
               .otherwise(VERDICT_INCONCLUSIVE))
    direction = (F.when(F.col("diff") > 0, "positive").when(F.col("diff") < 0, "negative")
                 .otherwise("none"))
    return stage3.select("*", verdict.alias("verdict"), direction.alias("direction"))


# --------------------------------------------------- stored experiments
STORED = "assignments"


def extend_assignment(stored: DataFrame, customers: DataFrame, salt: str, id_col: str = "customer_id") -> DataFrame:
    """X1 for customers who came later: (id, variant) of those not in ``stored``.

    They are ranked after all stored ones, in ``md5(salt || id)`` order among
    themselves, and the first of them are control until control holds
    floor(n / 2) of all; nobody who is stored changes arm.
    """
    new = customers.select(id_col).distinct().join(stored.select(id_col), id_col, "left_anti")
    ranked = rank_by_hash(new, id_col, salt, rank_col="_r", size_col="_n")
    held = stored.agg(F.count(F.lit(1)).alias("_held"),
                      F.coalesce(F.sum((F.col("variant") == CONTROL).cast("long")), F.lit(0)).alias("_control"))
    edge = F.floor((F.col("_held") + F.col("_n")) / 2) - F.col("_control")
    return attach_one_row(ranked, held).select(id_col, F.when(F.col("_r") <= edge, CONTROL).otherwise(TREATMENT).alias("variant"))


def read_experiment(spark: SparkSession, root: str) -> DataFrame:
    """The stored experiment table, in the declared schema; empty before the first load."""
    folders = manifest.current(spark, root).folders.get(STORED)
    if not folders:
        return spark.createDataFrame([], EXPERIMENT)
    return spark.read.schema(EXPERIMENT).parquet(*folders)


def enrol(customers: DataFrame, orders: DataFrame, root: str, salt: str, sent_at: str,
          window_days: int = CONVERSION_WINDOW_DAYS) -> int:
    """Assign customers who aren't stored yet, attribute their conversions, and append them.

    Stored rows are never rewritten. If another enrolment was published in
    between, its customers could be assigned twice, so this one is refused.
    """
    spark = customers.sparkSession
    now = manifest.current(spark, root)
    new = extend_assignment(read_experiment(spark, root), customers, salt)
    rows = attribute_conversions(new, orders, sent_at, window_days).select(*EXPERIMENT.fieldNames())
    path = manifest.new_folder(root, STORED)
    rows.write.parquet(path)

    def add(seen: manifest.Version) -> manifest.Folders:
        if seen.number != now.number:
            raise manifest.ConcurrentRefresh(f"{root} was extended while new customers were assigned")
        return {STORED: [*seen.folders.get(STORED, []), path]}
    return manifest.commit(spark, root, add)


# --------------------------------------------------- replicated experiments
def aa_replicates(outcomes: DataFrame, replicates: int, salt: str, id_col: str = "customer_id") -> DataFrame:
    """A/A calibration input: ``replicates`` random splits of the real outcomes, (replicate, variant, converted).

    Replicate r flips a fair coin per customer from ``md5(salt|r|id)``. Every row makes ``replicates`` rows, so the
    outcomes, few bytes each, are dealt to all tasks first; the caller aggregates right after, combining map-side.
    """
    width = int(outcomes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rep = outcomes.select(id_col, "converted").repartition(width).select(
        id_col, "converted", F.explode(F.sequence(F.lit(1), F.lit(int(replicates)))).alias("replicate"))
    coin = F.substring(F.md5(F.concat_ws("|", F.lit(salt), F.col("replicate").cast("string"),
                                         F.col(id_col).cast("string"))), 1, 1)
    return rep.select("replicate", F.when(coin < "8", CONTROL).otherwise(TREATMENT).alias("variant"), "converted")


def replicate_tests(replicates: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """X11 per replicate, a part or a new split of the experiment's own rows: arm counts, z-test, significance (degenerate = no)."""
    arms = arm_counts(replicates, by)
    n1, x1, n2, x2 = (F.col(c) for c in ("n_control", "x_control", "n_treatment", "x_treatment"))
    z, _ = ztest(x1, n1, x2, n2)
    with_p = arms.select("*", z.alias("z")).withColumn("p_value", two_sided_p(F.col("z")))
    return with_p.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def rejection_rate(replicates: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """X11: share of the replicates ``by`` with p < alpha (one row)."""
    tests = replicate_tests(replicates, by, alpha)
    return tests.agg(F.count(F.lit(1)).alias("replicates"),
                     F.sum(F.col("significant").cast("int")).cast("long").alias("rejections"),
                     _div(F.sum(F.col("significant").cast("int")), F.count(F.lit(1)))
                     .alias("rejection_rate"))


def power_comparison(replicates: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """The replicates' rejection rate next to the mean power (X8) that the rates of the whole
    experiment give at each replicate's control-arm size."""
    tests = replicate_tests(replicates, by, alpha)
    whole = arm_counts(replicates).select(_div(F.col("x_control"), F.col("n_control")).alias("_p1"),
                                          _div(F.col("x_treatment"), F.col("n_treatment")).alias("_p2"))
    tests = attach_one_row(tests, whole).withColumn(
        "_arg", power_argument(F.col("_p1"), F.col("_p2"), F.col("n_control"), alpha))
    return tests.agg(
        F.count(F.lit(1)).alias("replicates"),
        _div(F.sum(F.col("significant").cast("int")), F.count(F.lit(1))).alias("empirical_power"),
        F.avg(normal_cdf(F.col("_arg"))).alias("theoretical_power"),
    )


def expected_power(p1: float, p2: float, n: int, alpha: float = ALPHA) -> float:
    """X8 for scalars (driver-side helper for tests and reports)."""
    za = normal_quantile(1 - alpha / 2)
    p_bar = (p1 + p2) / 2
    se = math.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    num = abs(p2 - p1) * math.sqrt(n) - za * math.sqrt(2 * p_bar * (1 - p_bar))
    from statistics import NormalDist
    return NormalDist().cdf(num / se)


__all__ = [
    "assign", "attribute_conversions", "arm_summary", "arm_counts", "srm", "ztest", "diff_ci",
    "required_n", "achieved_power", "analyse", "extend_assignment", "read_experiment", "enrol",
    "aa_replicates", "replicate_tests", "rejection_rate", "power_comparison", "hash_key",
]
