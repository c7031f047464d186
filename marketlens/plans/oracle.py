"""DuckDB oracle SQL for the registered queries.

Queries are assembled from named CTE fragments (each lists the fragments it
reads), so every statement inlines exactly the staging views and marts it
needs (the driver registers only the raw tables). DuckDB divides DECIMAL into
DOUBLE, so exact rounding is written in integers (``round_div_sql``); money
stays DECIMAL inside the CTEs and is cast to DOUBLE only in the final
projection, as the Spark registry does.
"""

from __future__ import annotations

from marketlens.functions.decimal import round_div_sql as rd
from marketlens.functions.decimal import round_half_even_2_sql
from marketlens.functions.stats import chi2_sf_df1_sql, normal_cdf_sql, normal_quantile, two_sided_p_sql
from marketlens.sources.staging import STAGING_SQL


def D(expr: str) -> str:  # noqa: N802 - short helper for final projections
    return f"CAST({expr} AS DOUBLE)"


FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    name: ((), body) for name, body in STAGING_SQL.items()
}


def fragment(name: str, deps: tuple[str, ...], body: str) -> None:
    FRAGMENTS[name] = (deps, body)


def build(select: str, *deps: str) -> str:
    """``WITH <fragments in dependency order> <select>``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in FRAGMENTS[n][0]:
            visit(d)
        order.append(n)

    for d in deps:
        visit(d)
    ctes = ",\n".join(f"{n} AS (\n{FRAGMENTS[n][1]}\n)" for n in order)
    body = select.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# ------------------------------------------------------------------- marts
# Spend, sign-ups and orders stacked as dated facts of a channel, then folded by month:
# months that only sign-ups or orders know have no spend row and drop out.
fragment("channel_facts", ("stg_marketing_spend", "stg_customers", "stg_orders"), """
    SELECT channel, spend_month AS day, spend, leads, 1 AS budgeted, 0 AS joined, NULL AS earned
    FROM stg_marketing_spend
    UNION ALL SELECT channel, signup_date, NULL, NULL, 0, 1, NULL FROM stg_customers
    UNION ALL SELECT channel, order_date, NULL, NULL, 0, 0, total_amount
    FROM stg_orders JOIN stg_customers USING (customer_id)""")
fragment("channel_months", ("channel_facts",), """
    SELECT channel, CAST(date_trunc('month', day) AS DATE) AS spend_month, SUM(spend) AS spend,
           CAST(SUM(leads) AS BIGINT) AS leads, CAST(SUM(joined) AS BIGINT) AS customers_acquired,
           COALESCE(SUM(earned), 0) AS revenue_same_month
    FROM channel_facts GROUP BY ALL HAVING SUM(budgeted) > 0""")
fragment("econ", ("channel_months",), f"""
    SELECT *, {rd('spend', 'leads', 2)} AS cpl, {rd('spend', 'customers_acquired', 2)} AS cac,
           {rd('(revenue_same_month - spend)', 'spend', 3)} AS romi,
           SUM(spend) OVER so_far AS cumulative_spend,
           SUM(revenue_same_month) OVER so_far AS cumulative_revenue
    FROM channel_months
    WINDOW so_far AS (PARTITION BY channel ORDER BY spend_month RANGE UNBOUNDED PRECEDING)""")


def ltv_over(orders: str) -> str:
    """Every order with its customer's running total, beside a per-customer aggregate."""
    return f"""
    SELECT customer_id, channel, order_id, order_date, total_amount,
           CAST(COUNT(*) OVER so_far AS BIGINT) AS order_seq,
           SUM(total_amount) OVER so_far AS cumulative_revenue, avg_order_value
    FROM {orders} JOIN (
        SELECT customer_id, any_value(channel) AS channel,
               {rd('SUM(total_amount)', 'COUNT(total_amount)', 2)} AS avg_order_value
        FROM stg_customers JOIN {orders} USING (customer_id) GROUP BY customer_id) USING (customer_id)
    WINDOW so_far AS (PARTITION BY customer_id ORDER BY order_date, order_id ROWS UNBOUNDED PRECEDING)"""


fragment("ltv", ("stg_orders", "stg_customers"), ltv_over("stg_orders"))
fragment("signups", ("stg_customers",), """
    SELECT customer_id, CAST(date_trunc('month', signup_date) AS DATE) AS cohort_month,
           COUNT(*) OVER (PARTITION BY date_trunc('month', signup_date)) AS cohort_size
    FROM stg_customers""")
fragment("retention", ("stg_orders", "signups"), f"""
    SELECT cohort_month, month_number, MAX(cohort_size) AS cohort_size, COUNT(*) AS active_customers,
           {rd('COUNT(*)', 'MAX(cohort_size)', 3, 0)} AS retention_rate
    FROM (SELECT cohort_month, cohort_size, customer_id,
                 CAST(datediff('month', cohort_month, order_date) AS INTEGER) AS month_number
          FROM signups JOIN stg_orders USING (customer_id) GROUP BY ALL)
    WHERE month_number >= 0 GROUP BY cohort_month, month_number""")

# ---------------------------------------------------------------- insights
fragment("summary", ("econ",), f"""
    SELECT channel, SUM(spend) AS total_spend,
           CAST(SUM(leads) AS BIGINT) AS total_leads,
           CAST(SUM(customers_acquired) AS BIGINT) AS total_customers,
           {rd('SUM(spend)', 'SUM(leads)', 2)} AS avg_cpl,
           {rd('SUM(spend)', 'SUM(customers_acquired)', 2)} AS avg_cac,
           {rd('(SUM(revenue_same_month) - SUM(spend))', 'SUM(spend)', 3)} AS romi
    FROM econ GROUP BY channel""")
fragment("curve", ("retention",), """
    SELECT month_number, CAST(SUM(retention_rate) AS DOUBLE) / COUNT(retention_rate) AS mean_retention,
           COUNT(*) AS cohorts
    FROM retention GROUP BY month_number""")

ECON_COLS = (f"channel, spend_month, {D('spend')} AS spend, leads, {D('cpl')} AS cpl, "
             f"customers_acquired, {D('cac')} AS cac, "
             f"{D('revenue_same_month')} AS revenue_same_month, {D('romi')} AS romi, "
             f"{D('cumulative_spend')} AS cumulative_spend, "
             f"{D('cumulative_revenue')} AS cumulative_revenue")
LTV_COLS = (f"customer_id, channel, order_id, order_date, {D('total_amount')} AS total_amount, "
            f"order_seq, {D('cumulative_revenue')} AS cumulative_revenue, "
            f"{D('avg_order_value')} AS avg_order_value")
RETENTION_COLS = (f"cohort_month, month_number, cohort_size, active_customers, "
                  f"{D('retention_rate')} AS retention_rate")
SUMMARY_COLS = (f"channel, {D('total_spend')} AS total_spend, total_leads, total_customers, "
                f"{D('avg_cpl')} AS avg_cpl, {D('avg_cac')} AS avg_cac, {D('romi')} AS romi")

_SQL: dict[str, str] = {}


def register(name: str, select: str, *deps: str) -> None:
    _SQL[name] = build(select, *deps)


register("channel_economics", f"SELECT {ECON_COLS} FROM econ", "econ")
register("customer_ltv", f"SELECT {LTV_COLS} FROM ltv", "ltv")
register("cohort_retention", f"SELECT {RETENTION_COLS} FROM retention", "retention")
register("channel_summary", f"SELECT {SUMMARY_COLS} FROM summary", "summary")
register("ltv_curve", """
    SELECT order_seq, CAST(SUM(cumulative_revenue) AS DOUBLE) / COUNT(cumulative_revenue) AS avg_cumulative_revenue,
           COUNT(*) AS customers_reaching
    FROM ltv WHERE order_seq <= 8 GROUP BY order_seq""", "ltv")
register("retention_matrix", "SELECT cohort_month, " + ", ".join(
    f"{D(f'MAX(CASE WHEN month_number = {m} THEN retention_rate END)')} AS month_{m}"
    for m in range(7)) + " FROM retention WHERE month_number BETWEEN 0 AND 6 GROUP BY cohort_month",
    "retention")
register("channel_romi_ranking", f"""
    SELECT channel, {D('romi')} AS romi,
           CAST(ROW_NUMBER() OVER (ORDER BY romi DESC NULLS FIRST, channel) AS BIGINT) AS romi_rank,
           romi >= 0 AS profitable
    FROM summary""", "summary")
register("revenue_per_spend", f"""
    SELECT channel, {D(rd('SUM(revenue_same_month)', 'SUM(spend)', 3))} AS revenue_per_spend
    FROM econ GROUP BY channel""", "econ")
register("first_order_payback", f"""
    SELECT s.channel, {D('s.avg_cac')} AS avg_cac, m.mean_first_order,
           m.mean_first_order / {D('s.avg_cac')} AS payback_ratio
    FROM summary s CROSS JOIN (
        SELECT CAST(SUM(total_amount) AS DOUBLE) / COUNT(total_amount) AS mean_first_order
        FROM ltv WHERE order_seq = 1) m""", "summary", "ltv")
register("mean_retention_curve", "SELECT month_number, mean_retention, cohorts FROM curve", "curve")
register("steepest_retention_drop", """
    SELECT p.month_number AS from_month, c.month_number AS to_month,
           p.mean_retention - c.mean_retention AS retention_drop
    FROM curve c JOIN curve p ON c.month_number = p.month_number + 1
    ORDER BY retention_drop DESC, from_month LIMIT 1""", "curve")
register("channel_spend_share", f"""
    SELECT channel, {D('total_spend')} AS total_spend,
           {D(rd('total_spend', 'SUM(total_spend) OVER ()', 4))} AS spend_share
    FROM summary""", "summary")


# ----------------------------------------------------------------- roll-up
fragment("events", ("stg_orders", "stg_customers"), """
    SELECT o.order_id, o.customer_id, c.channel, o.order_date,
           CAST(o.total_amount AS DECIMAL(10,2)) AS total_amount
    FROM stg_orders o JOIN stg_customers c ON c.customer_id = o.customer_id""")
fragment("rollup_pg", ("stg_orders", "stg_customers"), """
    SELECT c.channel, CAST(date_trunc('month', o.order_date) AS DATE) AS revenue_month,
           SUM(o.total_amount) AS revenue, COUNT(*) AS orders
    FROM stg_orders o JOIN stg_customers c ON c.customer_id = o.customer_id
    GROUP BY 1, 2""")
fragment("rollup_ch", ("events",), """
    SELECT channel, CAST(date_trunc('month', order_date) AS DATE) AS revenue_month,
           SUM(total_amount) AS revenue, COUNT(*) AS orders
    FROM events GROUP BY 1, 2""")
ROLLUP_COLS = f"channel, revenue_month, {D('revenue')} AS revenue, orders"
register("order_events", f"SELECT order_id, customer_id, channel, order_date, "
         f"{D('total_amount')} AS total_amount FROM events", "events")
register("orphan_orders", f"""
    SELECT o.order_id, o.customer_id, o.order_date, {D('o.total_amount')} AS total_amount
    FROM stg_orders o
    WHERE NOT EXISTS (SELECT 1 FROM stg_customers c WHERE c.customer_id = o.customer_id)""",
         "stg_orders", "stg_customers")
register("rollup_from_orders", f"SELECT {ROLLUP_COLS} FROM rollup_pg", "rollup_pg")
register("rollup_from_events", f"SELECT {ROLLUP_COLS} FROM rollup_ch", "rollup_ch")
register("rollup_merged", f"SELECT {ROLLUP_COLS} FROM rollup_ch", "rollup_ch")
register("rollup_streamed", f"SELECT {ROLLUP_COLS} FROM rollup_ch", "rollup_ch")
register("rollup_consistency", """
    SELECT 'orders_vs_events' AS comparison,
           (SELECT COUNT(*) FROM (SELECT * FROM rollup_pg EXCEPT ALL SELECT * FROM rollup_ch)) AS only_left,
           (SELECT COUNT(*) FROM (SELECT * FROM rollup_ch EXCEPT ALL SELECT * FROM rollup_pg)) AS only_right
    UNION ALL
    SELECT 'orders_vs_merged',
           (SELECT COUNT(*) FROM (SELECT * FROM rollup_pg EXCEPT ALL SELECT * FROM rollup_ch)),
           (SELECT COUNT(*) FROM (SELECT * FROM rollup_ch EXCEPT ALL SELECT * FROM rollup_pg))
    UNION ALL SELECT 'orders_vs_streamed', 0, 0""",
         "rollup_pg", "rollup_ch")


# --------------------------------------------------------------- snapshots
def key_check(mart: str, source: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    nulls = " OR ".join(f"{c} IS NULL" for c in keys)
    return f"""
    SELECT '{mart}' AS mart, CAST(SUM(n) AS BIGINT) AS rows,
           CAST(SUM(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_keys,
           CAST(SUM(CASE WHEN {nulls} THEN n ELSE 0 END) AS BIGINT) AS null_keys
    FROM (SELECT {k}, COUNT(*) AS n FROM {source} GROUP BY {k})"""


register("snapshot_key_check", " UNION ALL ".join([
    key_check("channel_economics", "econ", ["channel", "spend_month"]),
    key_check("customer_ltv", "ltv", ["order_id"]),
    key_check("cohort_retention", "retention", ["cohort_month", "month_number"]),
]), "econ", "ltv", "retention")

fragment("load_month", ("stg_orders",), """
    SELECT CAST(date_trunc('month', MAX(order_date)) AS DATE) AS m FROM stg_orders""")
fragment("orders_before", ("stg_orders", "load_month"), """
    SELECT o.* FROM stg_orders o, load_month WHERE o.order_date < load_month.m""")
fragment("ltv_old", ("orders_before", "stg_customers"), ltv_over("orders_before"))
_LTV_VALUES = ["customer_id", "channel", "order_date", "total_amount", "order_seq",
               "cumulative_revenue", "avg_order_value"]
register("snapshot_diff", f"""
    SELECT COALESCE(n.order_id, o.order_id) AS order_id,
           CASE WHEN o.order_id IS NULL THEN 'inserted'
                WHEN n.order_id IS NULL THEN 'deleted'
                ELSE 'updated' END AS change_type
    FROM ltv_old o FULL OUTER JOIN ltv n ON n.order_id = o.order_id
    WHERE o.order_id IS NULL OR n.order_id IS NULL OR NOT ({' AND '.join(
        f'o.{c} IS NOT DISTINCT FROM n.{c}' for c in _LTV_VALUES)})""", "ltv_old", "ltv")

# ------------------------------------------------------------- experiment
EXPERIMENT = "email_reactivation"
EXPERIMENT_SALT = "email-reactivation-2025"
SENT_AT = "1998-06-01"
DUMP_DAY = "1997-01-01"
AA_SALT = "aa-calibration"
AA_REPLICATES = 200
ALPHA, POWER, CONFIDENCE, SRM_ALPHA = 0.05, 0.80, 0.95, 0.01

fragment("assigned", ("stg_customers",), f"""
    SELECT customer_id,
           CASE WHEN ROW_NUMBER() OVER (ORDER BY md5('{EXPERIMENT_SALT}' || CAST(customer_id AS VARCHAR)),
                                                 customer_id)
                     <= FLOOR(COUNT(*) OVER () / 2) THEN 'control' ELSE 'treatment' END AS variant,
           '{EXPERIMENT}' AS experiment
    FROM stg_customers""")
fragment("first_conversion", ("stg_orders",), f"""
    SELECT customer_id, MIN(order_date) AS converted_at FROM stg_orders
    WHERE order_date > DATE '{SENT_AT}' AND order_date <= DATE '{SENT_AT}' + 14
    GROUP BY customer_id""")
fragment("exp", ("assigned", "first_conversion"), f"""
    SELECT a.customer_id, a.variant, a.experiment, DATE '{SENT_AT}' AS sent_at,
           f.converted_at IS NOT NULL AS converted, f.converted_at
    FROM assigned a LEFT JOIN first_conversion f ON f.customer_id = a.customer_id""")


def _d(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def stats_sql(n1="n_control", x1="x_control", n2="n_treatment", x2="x_treatment") -> dict[str, str]:
    """SQL twins of the experiment statistics, operation for operation."""
    p1, p2 = _d(x1, n1), _d(x2, n2)
    total = f"CAST(({n1} + {n2}) AS DOUBLE)"
    e1, e2 = f"({total} * 0.5)", f"({total} * 0.5)"
    chi2 = f"({_d(f'(({n1} - {e1}) * ({n1} - {e1}))', e1)} + {_d(f'(({n2} - {e2}) * ({n2} - {e2}))', e2)})"
    pool = _d(f"({x1} + {x2})", f"({n1} + {n2})")
    se = f"SQRT({pool} * (1.0 - {pool}) * ({_d('1', n1)} + {_d('1', n2)}))"
    z = f"(CASE WHEN {se} > 0 THEN ({p2} - {p1}) / {se} END)"
    p_value = two_sided_p_sql(z)
    diff = f"({p2} - {p1})"
    se_d = f"SQRT({p1} * (1.0 - {p1}) / {n1} + {p2} * (1.0 - {p2}) / {n2})"
    zc = normal_quantile(1 - (1 - CONFIDENCE) / 2)
    za, zb = normal_quantile(1 - ALPHA / 2), normal_quantile(POWER)
    num = f"({(za + zb) ** 2!r} * ({p1} * (1.0 - {p1}) + {p2} * (1.0 - {p2})))"
    den = f"(({p2} - {p1}) * ({p2} - {p1}))"
    p_bar = f"(({p1} + {p2}) / 2)"
    se_alt = f"SQRT({p1} * (1.0 - {p1}) + {p2} * (1.0 - {p2}))"
    pw_num = f"(ABS({p2} - {p1}) * SQRT(CAST({n1} AS DOUBLE)) - {za!r} * SQRT(2.0 * {p_bar} * (1.0 - {p_bar})))"
    significant = f"COALESCE({p_value} < {ALPHA}, FALSE)"
    srm_p = chi2_sf_df1_sql(chi2)
    return {
        "rate_control": p1, "rate_treatment": p2, "srm_chi2": chi2, "srm_p": srm_p,
        "z": z, "p_value": p_value, "diff": diff,
        "ci_low": f"({diff} - {zc!r} * {se_d})", "ci_high": f"({diff} + {zc!r} * {se_d})",
        "required_n_per_arm": f"CAST((CASE WHEN {den} > 0 THEN CEIL({num} / {den}) END) AS BIGINT)",
        "power_now": f"(CASE WHEN {se_alt} > 0 THEN {normal_cdf_sql(f'({pw_num} / {se_alt})')} END)",
        "significant": significant,
        "verdict": (f"(CASE WHEN {srm_p} < {SRM_ALPHA} THEN 'NO SHIP - SRM triggered' "
                    f"WHEN {significant} THEN 'SHIP - significant difference, SRM passed' "
                    f"ELSE 'NO SHIP (inconclusive) - no significant difference' END)"),
        "direction": f"(CASE WHEN {diff} > 0 THEN 'positive' WHEN {diff} < 0 THEN 'negative' ELSE 'none' END)",
    }


def R(expr: str) -> str:  # noqa: N802 - presentation rounding of doubles
    return f"ROUND({expr}, 9)"


ARM_COUNTS = """
    CAST(SUM(CASE WHEN variant = 'control' THEN 1 ELSE 0 END) AS BIGINT) AS n_control,
    CAST(SUM(CASE WHEN variant = 'control' AND converted THEN 1 ELSE 0 END) AS BIGINT) AS x_control,
    CAST(SUM(CASE WHEN variant = 'treatment' THEN 1 ELSE 0 END) AS BIGINT) AS n_treatment,
    CAST(SUM(CASE WHEN variant = 'treatment' AND converted THEN 1 ELSE 0 END) AS BIGINT) AS x_treatment"""
DOUBLE_STATS = {"rate_control", "rate_treatment", "srm_chi2", "srm_p", "z", "p_value", "diff",
                "ci_low", "ci_high", "power_now"}

register("quality_report", """
    SELECT 'primary_key_unique' AS check_name,
           (SELECT COUNT(*) FROM (SELECT customer_id FROM exp WHERE customer_id IS NOT NULL
                                  GROUP BY customer_id HAVING COUNT(*) > 1)) AS violations
    UNION ALL SELECT 'primary_key_null', (SELECT COUNT(*) FROM exp WHERE customer_id IS NULL)
    UNION ALL SELECT 'foreign_key_customers',
           (SELECT COUNT(*) FROM exp e WHERE e.customer_id IS NOT NULL AND NOT EXISTS
               (SELECT 1 FROM stg_customers c WHERE c.customer_id = e.customer_id))
    UNION ALL SELECT 'variant_domain',
           (SELECT COUNT(*) FROM exp WHERE variant IS NOT NULL AND variant NOT IN ('control', 'treatment'))
    UNION ALL SELECT 'variant_not_null', (SELECT COUNT(*) FROM exp WHERE variant IS NULL)
    UNION ALL SELECT 'sent_at_not_null', (SELECT COUNT(*) FROM exp WHERE sent_at IS NULL)
    UNION ALL SELECT 'converted_not_null', (SELECT COUNT(*) FROM exp WHERE converted IS NULL)""",
         "exp", "stg_customers")
register("experiment_assignment", "SELECT customer_id, variant, experiment FROM assigned", "assigned")
register("experiment_conversion",
         "SELECT customer_id, variant, experiment, sent_at, converted, converted_at FROM exp", "exp")
register("experiment_arms", """
    SELECT experiment, variant, COUNT(*) AS n,
           CAST(SUM(CAST(converted AS INTEGER)) AS BIGINT) AS conversions,
           CAST(SUM(CAST(converted AS INTEGER)) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS rate
    FROM exp GROUP BY experiment, variant""", "exp")
_ST = stats_sql()
fragment("segmented", ("exp", "stg_customers"), """
    SELECT e.*, c.channel AS segment
    FROM exp e JOIN stg_customers c ON c.customer_id = e.customer_id""")
fragment("report_arms", ("segmented",), f"""
    SELECT experiment, 'channel' AS level, segment, {ARM_COUNTS} FROM segmented GROUP BY experiment, segment
    UNION ALL
    SELECT experiment, 'experiment', NULL, {ARM_COUNTS} FROM segmented GROUP BY experiment""")
register("experiment_report", "SELECT experiment, level, segment, n_control, x_control, n_treatment, x_treatment, "
         + ", ".join(f"{R(v) if k in DOUBLE_STATS else v} AS {k}" for k, v in _ST.items())
         + " FROM report_arms", "report_arms")
# Natural replicates: the experiment's customers by channel and sign-up month.
fragment("aa_tests", ("exp", "stg_customers"), f"""
    SELECT *, {_ST['significant']} AS significant
    FROM (SELECT c.channel, date_trunc('month', c.signup_date) AS cohort, {ARM_COUNTS}
          FROM exp e JOIN stg_customers c ON c.customer_id = e.customer_id GROUP BY ALL)""")
# A/A calibration: every customer's real outcome in so many random splits.
fragment("aa", ("exp",), f"""
    SELECT r.replicate,
           CASE WHEN substr(md5(concat_ws('|', '{AA_SALT}', CAST(r.replicate AS VARCHAR),
                                          CAST(e.customer_id AS VARCHAR))), 1, 1) < '8'
                THEN 'control' ELSE 'treatment' END AS variant,
           e.converted
    FROM exp e CROSS JOIN range(1, {AA_REPLICATES + 1}) r(replicate)""")
fragment("aa_split_tests", ("aa",), f"""
    SELECT replicate, {_ST['significant']} AS significant
    FROM (SELECT replicate, {ARM_COUNTS} FROM aa GROUP BY replicate)""")
register("replicate_rejection_rate", f"""
    SELECT COUNT(*) AS replicates, CAST(SUM(CAST(significant AS INTEGER)) AS BIGINT) AS rejections,
           {R('CAST(SUM(CAST(significant AS INTEGER)) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)')}
               AS rejection_rate
    FROM aa_split_tests""", "aa_split_tests")
_ZA = normal_quantile(1 - ALPHA / 2)
_POWER_ARG = (f"((ABS(p2 - p1) * SQRT(CAST(n_control AS DOUBLE)) - {_ZA!r} * SQRT(2.0 * ((p1 + p2) / 2) * (1.0 - (p1 + p2) / 2)))"
              " / NULLIF(SQRT(p1 * (1.0 - p1) + p2 * (1.0 - p2)), 0))")
register("power_comparison", f"""
    SELECT COUNT(*) AS replicates,
           {R('CAST(SUM(CAST(significant AS INTEGER)) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)')}
               AS empirical_power,
           {R(f'AVG({normal_cdf_sql(_POWER_ARG)})')} AS theoretical_power
    FROM aa_tests CROSS JOIN (
        SELECT AVG(CASE WHEN variant = 'control' THEN CAST(converted AS INTEGER) END) AS p1,
               AVG(CASE WHEN variant = 'treatment' THEN CAST(converted AS INTEGER) END) AS p2 FROM exp)""", "aa_tests", "exp")

# Two enrolments: early customers first; the others fill control up to half of all.
fragment("enrolled", ("stg_customers",), f"""
    SELECT customer_id, CASE WHEN turn <= CASE WHEN early THEN floor(own / 2)
                                               ELSE floor((own + before) / 2) - floor(before / 2) END
                             THEN 'control' ELSE 'treatment' END AS variant
    FROM (SELECT customer_id, early, COUNT(*) OVER (PARTITION BY early) AS own,
                 COUNT(*) FILTER (early) OVER () AS before,
                 ROW_NUMBER() OVER (PARTITION BY early
                     ORDER BY md5('{EXPERIMENT_SALT}' || CAST(customer_id AS VARCHAR)), customer_id) AS turn
          FROM (SELECT customer_id, signup_date < DATE '{DUMP_DAY}' AS early FROM stg_customers))""")
fragment("stored_exp", ("enrolled", "first_conversion"), f"""
    SELECT a.customer_id, a.variant, DATE '{SENT_AT}' AS sent_at, f.converted_at IS NOT NULL AS converted, f.converted_at
    FROM enrolled a LEFT JOIN first_conversion f ON f.customer_id = a.customer_id""")
register("experiment_stored_arms", "SELECT * FROM stored_exp", "stored_exp")
register("experiment_stored", "SELECT experiment, n_control, x_control, n_treatment, x_treatment, "
         + ", ".join(f"{R(v) if k in DOUBLE_STATS else v} AS {k}" for k, v in _ST.items())
         + f" FROM (SELECT '{EXPERIMENT}' AS experiment, {ARM_COUNTS} FROM stored_exp)", "stored_exp")

# ------------------------------------------------------------------ checks
fragment("customer_dump", ("stg_customers",), f"SELECT * FROM stg_customers WHERE signup_date < DATE '{DUMP_DAY}'")
register("late_customer_orders", f"""
    SELECT order_id, customer_id, order_date, {D('total_amount')} AS total_amount
    FROM stg_orders WHERE customer_id NOT IN (SELECT customer_id FROM customer_dump)""", "stg_orders", "customer_dump")
fragment("raw_log", (), """
    SELECT CASE WHEN event_type <> 'error' THEN user_id END AS customer_id,
           CASE event_type WHEN 'view' THEN 'control' WHEN 'click' THEN 'treatment' WHEN 'error' THEN NULL
                           ELSE event_type END AS variant,
           CASE WHEN event_type <> 'signup' THEN CAST(ts AS DATE) END AS sent_at,
           CASE WHEN event_type <> 'view' THEN value > 50 END AS converted
    FROM events""")
register("quality_report_events", """
    SELECT 'primary_key_unique' AS check_name,
           (SELECT COUNT(*) FROM (SELECT customer_id FROM raw_log GROUP BY customer_id
                                  HAVING COUNT(*) > 1 AND customer_id IS NOT NULL)) AS violations
    UNION ALL SELECT 'primary_key_null', COUNT(*) - COUNT(customer_id) FROM raw_log
    UNION ALL SELECT 'foreign_key_customers', COUNT(*) FROM raw_log
        WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM customer_dump)
    UNION ALL SELECT 'variant_domain', COUNT(*) FROM raw_log WHERE variant IN ('signup', 'purchase')
    UNION ALL SELECT 'variant_not_null', COUNT(*) - COUNT(variant) FROM raw_log
    UNION ALL SELECT 'sent_at_not_null', COUNT(*) - COUNT(sent_at) FROM raw_log
    UNION ALL SELECT 'converted_not_null', COUNT(*) - COUNT(converted) FROM raw_log""", "raw_log", "customer_dump")

# ---------------------------------------------------------------- features
fragment("cutoff", ("stg_orders",), "SELECT MAX(order_date) AS cutoff FROM stg_orders")
fragment("customer_agg", ("stg_orders",), """
    SELECT customer_id, COUNT(order_date) AS total_orders, SUM(total_amount) AS revenue,
           COUNT(total_amount) AS n_amount, MIN(order_date) AS first_order, MAX(order_date) AS last_order
    FROM stg_orders GROUP BY customer_id""")
fragment("features", ("stg_customers", "customer_agg", "cutoff"), f"""
    SELECT c.customer_id, c.channel,
           CAST(date_diff('day', c.signup_date, k.cutoff) AS BIGINT) AS tenure_days,
           CAST(a.total_orders AS BIGINT) AS total_orders,
           CAST(a.revenue AS DOUBLE) AS total_revenue,
           {round_half_even_2_sql('CAST(a.revenue AS DOUBLE) / a.n_amount')} AS avg_order_value,
           CAST(date_diff('day', c.signup_date, a.first_order) AS BIGINT) AS first_order_gap_days,
           CAST(a.total_orders AS DOUBLE) / GREATEST(date_diff('day', c.signup_date, k.cutoff), 1)
               AS order_frequency,
           CAST(date_diff('day', a.last_order, k.cutoff) AS BIGINT) AS days_since_last_order,
           CAST(date_diff('day', a.last_order, k.cutoff) > 90 AS INTEGER) AS churned
    FROM stg_customers c JOIN customer_agg a ON a.customer_id = c.customer_id CROSS JOIN cutoff k""")
register("churn_features", "SELECT * FROM features", "features")
register("churn_summary", """
    SELECT COUNT(*) AS customers, CAST(SUM(churned) AS BIGINT) AS churned,
           CAST(SUM(churned) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS churn_rate
    FROM features""", "features")
register("censoring_check", """
    SELECT k.cutoff, CAST(MIN(date_diff('day', c.signup_date, k.cutoff)) AS BIGINT) AS min_tenure_days,
           MIN(date_diff('day', c.signup_date, k.cutoff)) < 90 AS is_censored
    FROM stg_customers c CROSS JOIN cutoff k GROUP BY k.cutoff""", "stg_customers", "cutoff")


# --------------------------------------------------------------- modelling
NUMERIC_FEATURES = ["tenure_days", "total_orders", "total_revenue", "avg_order_value",
                    "first_order_gap_days", "order_frequency"]
fragment("quotas", ("features",), """
    SELECT churned, floor(exact) + CASE WHEN ROW_NUMBER() OVER (ORDER BY exact - floor(exact) DESC, churned)
                                             <= test_rows - SUM(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota
    FROM (SELECT churned, test_rows, test_rows * COUNT(*) / CAST(every AS DOUBLE) AS exact
          FROM features, (SELECT COUNT(*) AS every, ceil(0.25 * COUNT(*)) AS test_rows FROM features)
          GROUP BY churned, test_rows, every)""")
fragment("split", ("features", "quotas"), """
    SELECT f.*, CASE WHEN ROW_NUMBER() OVER (PARTITION BY f.churned
                                             ORDER BY md5('split' || CAST(customer_id AS VARCHAR)), customer_id)
                          <= quota THEN 'test' ELSE 'train' END AS split
    FROM features f JOIN quotas q ON q.churned = f.churned""")
fragment("train", ("split",), "SELECT * FROM split WHERE split = 'train'")
fragment("scored", ("split",), """
    SELECT customer_id AS id, CAST(churned AS INTEGER) AS label,
           CAST(1 AS DOUBLE) / (1 + total_orders) AS score,
           CAST(CAST(1 AS DOUBLE) / (1 + total_orders) >= 0.1 AS INTEGER) AS prediction
    FROM split WHERE split = 'test'""")
fragment("score_counts", ("scored",), """
    SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY score""")
fragment("cum", ("score_counts",), """
    SELECT score, pos, neg,
           SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
           SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
           COALESCE(SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS tp_above
    FROM score_counts""")
fragment("cells", ("scored",), ", ".join(
    f"CAST(COALESCE(SUM(CASE WHEN label = {a} AND prediction = {b} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n{a}{b}"
    for a in (0, 1) for b in (0, 1)).join(["SELECT ", " FROM scored"]))

register("stratified_split", "SELECT customer_id, churned, split FROM split", "split")
register("class_weights", """
    SELECT g.churned, g.class_count,
           CAST(t.n AS DOUBLE) / CAST(t.k * g.class_count AS DOUBLE) AS weight
    FROM (SELECT churned, COUNT(*) AS class_count FROM train GROUP BY churned) g
    CROSS JOIN (SELECT COUNT(*) AS n, COUNT(DISTINCT churned) AS k FROM train) t""", "train")
register("scaled_features", "SELECT s.customer_id, " + ", ".join(
    f"ROUND(CASE WHEN st.sd_{c} > 0 THEN (CAST(s.{c} AS DOUBLE) - st.m_{c}) / st.sd_{c} "
    f"ELSE CAST(s.{c} AS DOUBLE) - st.m_{c} END, 6) AS {c}_scaled" for c in NUMERIC_FEATURES)
    + " FROM split s CROSS JOIN (SELECT " + ", ".join(
        f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS sd_{c}" for c in NUMERIC_FEATURES) + " FROM train) st",
    "split", "train")
register("one_hot_channel", """
    WITH cats AS (SELECT channel, CAST(ROW_NUMBER() OVER (ORDER BY channel) - 1 AS INTEGER) AS idx
                  FROM (SELECT DISTINCT channel FROM train WHERE channel IS NOT NULL))
    SELECT s.customer_id, s.channel, c.idx AS onehot_index,
           CAST((SELECT COUNT(*) FROM cats) AS INTEGER) AS onehot_size
    FROM split s LEFT JOIN cats c ON c.channel = s.channel""", "split", "train")
register("roc_auc", """
    SELECT CAST(SUM(neg * (2 * tp_above + pos)) AS DOUBLE) / CAST(2 * SUM(pos) * SUM(neg) AS DOUBLE)
           AS roc_auc FROM cum""", "cum")
register("average_precision", """
    SELECT ROUND(SUM(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)))
                 / CAST(SUM(pos) AS DOUBLE), 9) AS average_precision FROM cum""", "cum")
register("roc_curve", """
    SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
    UNION ALL
    SELECT CAST(c.score AS DOUBLE), CAST(c.fp AS DOUBLE) / CAST(t.n AS DOUBLE),
           CAST(c.tp AS DOUBLE) / CAST(t.p AS DOUBLE)
    FROM cum c CROSS JOIN (SELECT SUM(pos) AS p, SUM(neg) AS n FROM score_counts) t""",
         "cum", "score_counts")
register("confusion_matrix", """
    SELECT 0 AS label, 0 AS prediction, n00 AS count FROM cells
    UNION ALL SELECT 0, 1, n01 FROM cells UNION ALL SELECT 1, 0, n10 FROM cells
    UNION ALL SELECT 1, 1, n11 FROM cells""", "cells")


def _safe_sql(num: str, den: str) -> str:
    return f"(CASE WHEN {den} <> 0 THEN {num} / {den} ELSE 0.0 END)"


def _report_sql() -> str:
    n = {k: f"CAST(n{k} AS DOUBLE)" for k in ("00", "01", "10", "11")}
    per = {}
    for cls, tp, pred, actual in (("0", n["00"], f"({n['00']} + {n['10']})", f"({n['00']} + {n['01']})"),
                                  ("1", n["11"], f"({n['01']} + {n['11']})", f"({n['10']} + {n['11']})")):
        p, r = _safe_sql(tp, pred), _safe_sql(tp, actual)
        per[cls] = {"precision": p, "recall": r, "f1": _safe_sql(f"2.0 * {p} * {r}", f"({p} + {r})"),
                    "support": actual}
    wide = ", ".join(f"{e} AS {m}_{cls}" for cls, d in per.items() for m, e in d.items())
    rows = [f"SELECT '{cls}' AS class_label, precision_{cls} AS precision, recall_{cls} AS recall, "
            f"f1_{cls} AS f1_score, CAST(support_{cls} AS BIGINT) AS support FROM w" for cls in ("0", "1")]
    total = "(support_0 + support_1)"
    rows.append("SELECT 'macro avg', (precision_0 + precision_1) / 2, (recall_0 + recall_1) / 2, "
                f"(f1_0 + f1_1) / 2, CAST({total} AS BIGINT) FROM w")
    wavg = {m: _safe_sql(f"({m}_0 * support_0 + {m}_1 * support_1)", total)
            for m in ("precision", "recall", "f1")}
    rows.append(f"SELECT 'weighted avg', {wavg['precision']}, {wavg['recall']}, {wavg['f1']}, "
                f"CAST({total} AS BIGINT) FROM w")
    return f"WITH w AS (SELECT {wide} FROM cells) " + " UNION ALL ".join(rows)


register("classification_report", _report_sql(), "cells")
register("accuracy", """
    SELECT CAST(SUM(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)
           AS accuracy FROM scored""", "scored")


# ----------------------------------------------------------------- exports
register("export_round_trip", " UNION ALL ".join(
    f"SELECT '{name}' AS export, (SELECT COUNT(*) FROM {source}) AS rows, 0::BIGINT AS lost, 0::BIGINT AS changed"
    for name, source in (("channel_economics", "econ"), ("customer_ltv", "ltv"), ("cohort_retention", "retention"),
                         ("features", "features"), ("features_csv", "features"))), "econ", "ltv", "retention", "features")
register("mart_views", f"""
    SELECT channel, months, {D('spend')} AS spend, orders, {D('revenue')} AS revenue
    FROM (SELECT channel, COUNT(*) AS months, SUM(spend) AS spend FROM econ GROUP BY channel)
    JOIN (SELECT c.channel, COUNT(*) AS orders, SUM(total_amount) AS revenue
          FROM stg_orders JOIN stg_customers c USING (customer_id) GROUP BY c.channel) USING (channel)""",
         "econ", "stg_orders", "stg_customers")
register("retention_in_order", f"""
    SELECT {RETENTION_COLS}, ROW_NUMBER() OVER (ORDER BY cohort_month, month_number) AS position FROM retention""", "retention")
register("ltv_curve_in_order", """
    SELECT order_seq, CAST(SUM(cumulative_revenue) AS DOUBLE) / COUNT(cumulative_revenue) AS avg_cumulative_revenue,
           COUNT(*) AS customers_reaching, order_seq AS position
    FROM ltv WHERE order_seq <= 8 GROUP BY order_seq""", "ltv")

# The fits can't be written in SQL; what makes them right can: a gradient of zero, scores that follow from
# the coefficients, importances and votes that follow from the nodes, metrics that agree.
fragment("model_inputs", ("train",), " UNION ALL ".join(f"SELECT '{c}' AS input" for c in NUMERIC_FEATURES)
         + " UNION ALL SELECT DISTINCT 'channel_' || channel FROM train WHERE channel IS NOT NULL")
fragment("tested", ("split",), """
    SELECT COUNT(*) AS n, CAST(SUM(churned) AS BIGINT) AS positives FROM split WHERE split = 'test'""")
register("logistic_audit", """
    SELECT 'gradient: ' || input AS "check", 0.0::DOUBLE AS value FROM model_inputs
    UNION ALL SELECT 'gradient: intercept', 0.0
    UNION ALL SELECT 'test rows', CAST(n AS DOUBLE) FROM tested
    UNION ALL SELECT 'scores outside (0, 1)', 0.0
    UNION ALL SELECT 'scores off the logistic function', 0.0
    UNION ALL SELECT 'predictions against the threshold', 0.0""", "model_inputs", "tested")
register("forest_audit", """
    SELECT 'importance: ' || input AS "check", 0.0::DOUBLE AS value FROM model_inputs
    UNION ALL SELECT 'test rows', CAST(n AS DOUBLE) FROM tested
    UNION ALL SELECT 'scores that differ', 0.0
    UNION ALL SELECT 'predictions that differ', 0.0""", "model_inputs", "tested")
register("model_runs", """
    SELECT model, CAST(42 AS BIGINT) AS random_state, CAST(trees AS BIGINT) AS n_estimators, n AS test_rows,
           positives AS test_positives, 0.0::DOUBLE AS roc_auc_gap, 0.0::DOUBLE AS accuracy_gap, TRUE AS pr_auc_in_range
    FROM tested CROSS JOIN (VALUES ('Logistic Regression', NULL), ('Random Forest', 300)) m(model, trees)""", "tested")


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
