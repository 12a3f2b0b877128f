"""Numbers as text: rounding goes by the exact value, at ties as elsewhere."""

from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F

from variantlab.functions import expr


def plain(x):
    if x is None:
        return "None"
    size = abs(x)
    if size >= 100:
        return f"{x:.0f}"
    return f"{x:.2f}" if size >= 1 else f"{x:.4f}" if size >= 0.001 else f"{x:.2e}"


def test_ties_round_by_the_exact_value(spark):
    rng = random.Random(2)
    values = [None, 3.555e-05, 1.005, 2.675, 0.00015, 0.12345, 0.5, 2.5, 99.995, 9.995e-05, 9.9995e-4, 100.5, 101.5, 1e-19, 0.0, 1.125, 1.375, 0.00125, 0.03125, 1e9, 0.001]
    for _ in range(4000):
        k = rng.randint(0, 20)
        values += [float(Decimal(rng.randint(1, 99999)).scaleb(-k)), rng.random() * 10.0 ** -rng.randint(-3, 18), float(Decimal(rng.randint(100, 999) * 10 + 5).scaleb(-k))]
    values = [v for v in values if v is None or v == 0 or v >= 1e-19] + [-v for v in values[1:400]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = {r.i: r.s for r in df.select("i", expr.shown(F.col("x")).alias("s")).collect()}
    wrong = [(v, got[i], plain(v)) for i, v in enumerate(values) if got[i] != plain(v) and v != 0]
    assert not wrong, wrong[:5]
