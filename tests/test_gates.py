"""Percentages in the gates' reasons: printed as C does, ties to even."""

from pyspark.sql import functions as F

from lakeglass.operators import gates


def test_one_place_is_that_of_the_binary_value(spark):
    made = [n / d * 100 for d in range(1, 150) for n in range(0, d + 1, 1 + d // 40)] + [k / 20 for k in range(0, 2100)] + [56.25, 56.35, 0.05, 0.15, 0.25, 0.35, 99.95, 100.0, 999.95, 1e-9, 0.049999999999999996]
    rows = spark.createDataFrame([(x,) for x in made], "x double").select("x", gates.one_place(F.col("x")).alias("s")).collect()
    assert [(r["x"], r["s"]) for r in rows if r["s"] != f"{r['x']:.1f}"] == []


def test_a_tie_in_a_reason(spark):
    """9 of 16 characters are 56.25 %."""
    one = lambda item, a, b: f"named_struct('item', '{item}', 'start', {a}, 'end', {b}, 'title', '')"
    df = spark.sql(f"SELECT array({one('2', 0, 9)}, {one('7', 9, 16)}) AS s, 16 AS t").select(gates.strict_v2(F.col("s"), F.col("t")).alias("v2"), gates.strict_v1(F.col("s"), F.col("t")).alias("v1"))
    assert tuple(df.first()) == ("section dominance: Item 2 (56.2%)", "single section dominates (56.2% > 50%)")
