"""Statistical functions as Column expressions, with DuckDB SQL twins.

Neither Spark nor DuckDB ships ``erf``; the normal CDF is the double-precision
rational approximation of Hart (1968) in the form published by West (2005,
"Better approximations to cumulative normal functions"). It is a pure
arithmetic expression, so it stays inside whole-stage codegen, and the same
text evaluates in DuckDB for the oracle. Quantiles are only ever needed for
configured constants (alpha, power, confidence), so they are driver-side
literals from the Python standard library.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's coefficients for the normal tail, highest power first.
NUMERATOR = [
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
DENOMINATOR = [
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
SPLIT = 7.07106781186547
CUTOFF = 37.0
SQRT_2PI = 2.506628274631


def _horner(coefs: list[float], a, lit):
    acc = lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * a + lit(c)
    return acc


def normal_tail(x: Column) -> Column:
    """Lower tail Φ(-|x|) for a DOUBLE column (``c`` in West's notation)."""
    a = F.abs(x.cast("double"))
    e = F.exp(-a * a / 2)
    rational = e * _horner(NUMERATOR, a, F.lit) / _horner(DENOMINATOR, a, F.lit)
    cont = a + F.lit(1) / (a + F.lit(2) / (a + F.lit(3) / (a + F.lit(4) / (a + F.lit(0.65)))))
    fraction = e / cont / F.lit(SQRT_2PI)
    return (F.when(a < SPLIT, rational)
            .when(a <= CUTOFF, fraction)
            .when(a > CUTOFF, F.lit(0.0)))  # NULL stays NULL


def normal_cdf(x: Column) -> Column:
    """Φ(x)."""
    c = normal_tail(x)
    return F.when(x > 0, F.lit(1.0) - c).otherwise(c)


def two_sided_p(z: Column) -> Column:
    """``2 * (1 - Φ(|z|))`` in the reference's form."""
    return F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))


def chi2_sf_df1(chi2: Column) -> Column:
    """Survival function of chi-square with one degree of freedom."""
    return two_sided_p(F.sqrt(chi2))


def normal_quantile(p: float) -> float:
    """Φ⁻¹(p) for a configured constant (a literal, never a column)."""
    return NormalDist().inv_cdf(p)


# ---------------------------------------------------------------- SQL twins
def _horner_sql(coefs: list[float], a: str) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {a} + {c!r})"
    return acc


def normal_tail_sql(x: str) -> str:
    a = f"ABS(CAST({x} AS DOUBLE))"
    e = f"EXP(-{a} * {a} / 2)"
    rational = f"({e} * {_horner_sql(NUMERATOR, a)} / {_horner_sql(DENOMINATOR, a)})"
    cont = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65)))))"
    fraction = f"({e} / {cont} / {SQRT_2PI!r})"
    return (f"(CASE WHEN {a} < {SPLIT!r} THEN {rational} "
            f"WHEN {a} <= {CUTOFF!r} THEN {fraction} WHEN {a} > {CUTOFF!r} THEN 0.0 END)")


def normal_cdf_sql(x: str) -> str:
    c = normal_tail_sql(x)
    return f"(CASE WHEN {x} > 0 THEN 1.0 - {c} ELSE {c} END)"


def two_sided_p_sql(z: str) -> str:
    return f"(2.0 * (1.0 - {normal_cdf_sql(f'ABS({z})')}))"


def chi2_sf_df1_sql(chi2: str) -> str:
    return two_sided_p_sql(f"SQRT({chi2})")
