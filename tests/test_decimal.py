"""Exact rounding helpers against Python's decimal module (brute force)."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import functions as F

from marketlens.functions.decimal import round_div, round_half_even_2


def test_round_div_matches_exact_half_away_from_zero(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(2000):
        a = Decimal(rng.randint(-10 ** rng.randint(1, 30), 10 ** rng.randint(1, 30))) / 100
        b = rng.choice([0, None, rng.randint(1, 10 ** rng.randint(1, 17)), -rng.randint(1, 1000)])
        rows.append((a, b))
    rows += [(Decimal("0.05"), 2), (Decimal("-0.05"), 2), (Decimal("-0.04"), 80),
             (Decimal("12.50"), 1000), (Decimal("-12.50"), 1000)]
    df = spark.createDataFrame(rows, "a decimal(30,2), b long")
    for digits in (2, 3):
        quantum = Decimal(1).scaleb(-digits)
        for r in df.select("a", "b", round_div(F.col("a"), F.col("b"), digits).alias("r")).collect():
            if r.b in (None, 0):
                assert r.r is None
                continue
            with localcontext() as ctx:
                ctx.prec = 90
                expected = (r.a / Decimal(r.b)).quantize(quantum, rounding=ROUND_HALF_UP)
            assert r.r == expected, (r, expected)


def test_round_half_even_matches_python_round(spark):
    vals = [0.125, 0.135, 2.675, 1.005, -0.125, 75.0, 10.005, 3.14159]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.y for r in df.select(round_half_even_2(F.col("x")).alias("y")).collect()]
    import numpy as np
    assert got == [float(np.round(v, 2)) for v in vals]


def test_recommended_conf_scales_partitions():
    from marketlens.session import recommended_conf
    small = recommended_conf(10 * 1024 ** 2)
    big = recommended_conf(100 * 1024 ** 4)
    assert small["spark.sql.shuffle.partitions"] == "8"
    assert big["spark.sql.shuffle.partitions"] == str(100 * 1024 ** 4 // (256 * 1024 ** 2))
    assert recommended_conf(1024 ** 4)["spark.sql.shuffle.partitions"] == "4096"
    assert big["spark.sql.adaptive.enabled"] == "true"
