"""Statistics: one-sided Fisher test, correlation p-values, entropy, adjusted Rand index, histogram troughs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """P(X >= a) of the hypergeometric table [[a, b], [c, d]]; 1 if a margin is 0."""
    most = int((a + b + c + d).max()) if len(a) else 0
    fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])

    def tail(a: int, b: int, c: int, d: int) -> float:
        r, s, k, m = a + b, c + d, a + c, b + d
        if 0 in (r, s, k, m):
            return 1.0
        x = np.arange(a, min(r, k) + 1)
        logs = fact[r] - fact[x] - fact[r - x] + fact[s] - fact[k - x] - fact[s - k + x] - (fact[r + s] - fact[k] - fact[r + s - k])
        return float(min(1.0, np.exp(logs).sum()))

    return pd.Series([tail(*map(int, t)) for t in zip(a, b, c, d, strict=True)])


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Sample odds ratio: infinite on a zero denominator, NaN if a margin is 0."""
    empty = (a + b == 0) | (c + d == 0) | (a + c == 0) | (b + d == 0)
    return F.when(empty, F.lit(float("nan"))).when((b == 0) | (c == 0), F.lit(float("inf"))).otherwise(F.try_divide((a * d).cast("double"), b * c))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # modified Lentz evaluation: terms alternate between the odd and even coefficients
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * f


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation coefficient over n points."""
    return pd.Series([incomplete_beta((k - 2) / 2, 0.5, 1 - x * x) if x == x and k > 2 else float("nan") for x, k in zip(r, n, strict=True)])


def entropy(counts: Column) -> Column:
    """Shannon entropy (nats) of an array of counts; -1 without any."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.ln(x / total)).otherwise(0.0))
    return F.when(total > 0, bits).otherwise(-1.0)


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ari) of two labellings, from pair counts in closed form."""
    two = lambda n: n * (n - 1) / 2
    cells = pairs.groupBy(a, b).count()
    cell = cells.agg(F.sum(two(F.col("count"))).alias("i"), F.sum("count").alias("n"))
    rows = pairs.groupBy(a).count().agg(F.sum(two(F.col("count"))).alias("x"))
    cols = pairs.groupBy(b).count().agg(F.sum(two(F.col("count"))).alias("y"))
    e = F.col("x") * F.col("y") / two(F.col("n"))
    top, bottom = F.col("i") - e, (F.col("x") + F.col("y")) / 2 - e
    return cell.join(rows).join(cols).select(F.when(bottom == 0, 1.0).otherwise(F.try_divide(top, bottom)).alias("ari"))


def troughs(hist: DataFrame, d: str = "d", n: str = "n") -> DataFrame:
    """(threshold): local minima of the dense histogram over 0..max+1, a plateau by its middle (rounded down), in no order.

    The number of distinct distances bounds the rows that are ordered here, not the number of samples.
    """
    top = hist.agg(F.max(d).alias("top"))
    dense = top.select(F.explode(F.sequence(F.lit(0), F.col("top") + 1)).alias(d)).join(hist, d, "left").select(d, F.coalesce(n, F.lit(0)).alias("y"))
    w = Window.orderBy(d)
    runs = dense.withColumn("new", F.coalesce((F.col("y") != F.lag("y").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy("run").agg(F.min(d).alias("l"), F.max(d).alias("r"), F.first("y").alias("y"))
    v = Window.orderBy("run")
    ends = runs.withColumn("before", F.lag("y").over(v)).withColumn("after", F.lead("y").over(v))
    return ends.where("before > y AND after > y").select(F.floor((F.col("l") + F.col("r")) / 2).cast("long").alias("threshold"))


def integer_ranges(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Runs of consecutive integers: by, first, last."""
    w = Window.partitionBy(*by).orderBy(value)
    island = df.select(*by, value).distinct().withColumn("island", F.col(value) - F.row_number().over(w))
    return island.groupBy(*by, "island").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("island")


#: Terms of an expected information that one row sums.
_TERMS = 1024


def ln_factorial(n: Column) -> Column:
    """Natural logarithm of n!, from a table up to 31 and Stirling's series beyond (error below 1e-15)."""
    table = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(32)))
    x = n.cast("double") + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < 32, F.get(table, n.cast("int"))).otherwise(series)


def expected_information(rows: DataFrame, cols: DataFrame, n: int) -> DataFrame:
    """One row (expected): the mean information of random labellings with these cluster sizes; rows (x, times) and cols (y, times) hold distinct sizes and how often they occur.

    There are at most sqrt(2 n) distinct sizes on a side, so their pairs number 2 n at most; the terms of a pair are dealt in blocks of ``_TERMS``.
    """
    pairs = rows.select("x", F.col("times").alias("tx")).join(cols.select("y", F.col("times").alias("ty")))
    total = F.lit(n).cast("long")
    pairs = pairs.withColumns({"lo": F.greatest(F.lit(1).cast("long"), F.col("x") + F.col("y") - total), "hi": F.least("x", "y")})
    fixed = ln_factorial(F.col("x")) + ln_factorial(F.col("y")) + ln_factorial(total - F.col("x")) + ln_factorial(total - F.col("y")) - ln_factorial(total)
    blocks = pairs.withColumn("fixed", fixed).withColumn("k0", F.explode(F.sequence("lo", "hi", F.lit(_TERMS).cast("long"))))

    def term(k: Column) -> Column:
        logp = F.col("fixed") - ln_factorial(k) - ln_factorial(F.col("x") - k) - ln_factorial(F.col("y") - k) - ln_factorial(total - F.col("x") - F.col("y") + k)
        return k / total * F.ln(total.cast("double") * k / (F.col("x").cast("double") * F.col("y"))) * F.exp(logp)

    each = F.aggregate(F.sequence("k0", F.least(F.col("k0") + (_TERMS - 1), F.col("hi"))), F.lit(0.0), lambda acc, k: acc + term(k))
    return blocks.select((each * F.col("tx") * F.col("ty")).alias("e")).agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("expected"))


def adjusted_mutual_info(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ami): adjusted mutual information (arithmetic mean of entropies) of two labellings; null is a label of its own.

    1 for no rows, for a single cluster on both sides and for single rows throughout.  Only the number of rows reaches the driver.
    """
    n = pairs.count()
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("c"))
    sizes = lambda by, name: cells.groupBy(by).agg(F.sum("c").alias(name)).groupBy(name).agg(F.count("*").alias("times"))
    rows, cols = sizes(a, "x"), sizes(b, "y")

    def entropy_of(df: DataFrame, c: str, times: Column, name: str) -> DataFrame:
        p = F.col(c) / F.lit(float(max(n, 1)))
        return df.agg((-F.sum(times * p * F.ln(p))).alias(name), F.sum(times).alias(f"k_{name}"))

    one = entropy_of(rows, "x", F.col("times"), "hx").join(entropy_of(cols, "y", F.col("times"), "hy")).join(entropy_of(cells, "c", F.lit(1), "hc")).join(expected_information(rows, cols, n))
    bottom = (F.col("hx") + F.col("hy")) / 2 - F.col("expected")
    eps = float(np.finfo(float).eps)
    bottom = F.when(bottom < 0, F.least(bottom, F.lit(-eps))).otherwise(F.greatest(bottom, F.lit(eps)))
    alike = (F.col("k_hx") == F.col("k_hy")) & F.col("k_hx").isin(1, n)
    return one.select(F.when(alike | F.lit(n == 0), 1.0).otherwise((F.col("hx") + F.col("hy") - F.col("hc") - F.col("expected")) / bottom).alias("ami"))
