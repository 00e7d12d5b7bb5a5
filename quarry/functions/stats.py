"""Descriptive and comparative statistics of measured runs and rule scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed bounds of quality bands, worst to best.
BANDS = {"confidence": (0.5, 0.8, 0.9), "support": (0.1, 0.5, 0.8), "accuracy": (0.6, 0.8, 0.95)}
BAND_NAMES = ("low", "fair", "good", "excellent")


def _beside(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns for the same by, nulls included; without by, right has one row."""
    if not by:
        return left.join(F.broadcast(right), F.lit(True), how)
    other = right.select(*(F.col(b).alias(f"__by{i}") for i, b in enumerate(by)), *(c for c in right.columns if c not in by))
    same = [F.col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)]
    return left.join(other, reduce(Column.__and__, same), how).drop(*(f"__by{i}" for i in range(len(by))))


def elements_at(df: DataFrame, value: str, by: list[str], at: dict[str, Column], near: float = 0.5, wide: float = 0.002) -> DataFrame:
    """by, n, then a column per entry of at: the element of that place (from 0, an expression of n) among the sorted non-null
    values. Places must lie about the share near of all.

    No group is sorted whole: two approximate quantiles enclose the wanted places, values below them are counted, and only the
    share of values between them is numbered."""
    v = F.col(value).cast("double")
    per = df.where(v.isNotNull()).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__c"))
    low, high = max(0.0, near - wide), min(1.0, near + wide)
    bounds = df.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(v, [low, high], 10_000).alias("__q"), F.min(v).alias("__min"), F.max(v).alias("__max"))
    edge = lambda i, far: F.when(F.col("n") < 10_000, F.col(far)).otherwise(F.col("__q")[i])
    bounds = bounds.withColumns({"__low": edge(0, "__min"), "__high": edge(1, "__max")})
    both = _beside(per, bounds, by)
    counts = both.groupBy(*by).agg(F.sum(F.when(F.col("__v") < F.col("__low"), F.col("__c")).otherwise(0)).alias("__before"))
    inside = both.where(F.col("__v").between(F.col("__low"), F.col("__high")))
    through = F.sum("__c").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__v"))
    inside = inside.withColumn("__through", through)
    inside = _beside(inside, counts, by)
    end, begin = F.col("__before") + F.col("__through"), F.col("__before") + F.col("__through") - F.col("__c")
    picked = [F.max(F.when((begin <= place) & (place < end), F.col("__v"))).alias(name) for name, place in at.items()]
    return inside.groupBy(*by).agg(F.first("n").alias("n"), *picked)


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, n, mean, std (sample; 0 for one value), median, min, max, of the non-null values. Without by and without values: one row
    with n 0 and nulls."""
    by = by or []
    present = df.where(F.col(value).isNotNull())
    v = F.col(value).cast("double")
    measures = {"n": F.count("*"), "mean": F.avg(v), "std": F.coalesce(F.stddev_samp(v), F.lit(0.0)), "min": F.min(v), "max": F.max(v)}
    plain = present.groupBy(*by).agg(*(c.alias(n) for n, c in measures.items()))
    n = F.col("n")
    middle = elements_at(df, value, by, {"__a": F.floor((n - 1) / 2), "__b": F.floor(n / 2)}).select(*by, ((F.col("__a") + F.col("__b")) / 2).alias("median"))
    return _beside(plain, middle, by, "left").select(*by, "n", "mean", "std", "median", "min", "max")


def with_interval(described: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds ci_low and ci_high of the mean by Student's t; quantiles are looked up per distinct n on the driver."""
    quantiles = {r["n"]: t_quantile(0.5 + level / 2, r["n"] - 1) if r["n"] > 1 else 0.0 for r in described.select("n").distinct().collect()}
    look = F.create_map(*(F.lit(x) for kv in quantiles.items() for x in kv)) if quantiles else F.create_map()
    half = F.coalesce(look[F.col("n")], F.lit(0.0)) * F.col("std") / F.sqrt("n")
    return described.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def alternative(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, n, mean, std (population), upper_median (the element at n // 2), share_high (at least 0.8), share_low (under 0.5)."""
    by = by or []
    v = F.col(value).cast("double")
    measures = [
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.avg((v >= 0.8).cast("double")).alias("share_high"), F.avg((v < 0.5).cast("double")).alias("share_low"),
    ]
    out = df.where(v.isNotNull()).groupBy(*by).agg(*measures)
    middle = elements_at(df, value, by, {"upper_median": F.floor(F.col("n") / 2)}).drop("n")
    return _beside(out, middle, by, "left")


def band(value: Column, kind: str) -> Column:
    """A name of BAND_NAMES by the kind's bounds; null stays null."""
    low, middle, high = BANDS[kind]
    return F.when(value < low, BAND_NAMES[0]).when(value < middle, BAND_NAMES[1]).when(value < high, BAND_NAMES[2]).when(value.isNotNull(), BAND_NAMES[3])


def valid_metric(value: Column, bounded: bool = True) -> Column:
    """Neither null, NaN nor infinite and, if bounded, from 0 to 1."""
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.coalesce(fine & value.between(0, 1) if bounded else fine, F.lit(False))


def t_test(df: DataFrame, value: str, group: str, a: object, b: object) -> DataFrame:
    """One row: n_a, n_b, mean_a, mean_b, t (pooled variance), df, cohen_d (absolute); null with under two values on a side."""
    v = F.col(value).cast("double")
    side = lambda x, f: f(F.when(F.col(group) == x, v))
    m = df.agg(*(side(x, f).alias(f"{n}_{k}") for k, x in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))))
    freedom = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / freedom
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (pooled > 0)
    gap = F.col("mean_a") - F.col("mean_b")
    return m.select(
        "n_a", "n_b", "mean_a", "mean_b", F.when(enough, gap / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))).alias("t"), freedom.alias("df"),
        F.when(enough, F.abs(gap) / F.sqrt(pooled)).alias("cohen_d"),
    )


def u_test(df: DataFrame, value: str, group: str, a: object, b: object) -> DataFrame:
    """One row: n_a, n_b, u (of a, with mid-ranks for ties), rank_biserial (absolute), z (normal approximation, corrected for ties
    and continuity). Ties are counted per distinct value first; the running sum then goes over distinct values alone."""
    v = F.col(value).cast("double")
    sides = df.where(F.col(group).isin(a, b) & v.isNotNull())
    per = sides.groupBy(v.alias("v")).agg(F.count_if(F.col(group) == a).alias("a"), F.count_if(F.col(group) == b).alias("b"))
    numbered = cumulated(per, "v", ["a", "b"])
    rank = F.col("before_a") + F.col("before_b") + (F.col("a") + F.col("b") + 1) / 2
    ties = F.col("a") + F.col("b")
    s = numbered.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * rank).alias("ranks"), F.sum(ties * ties * ties - ties).cast("double").alias("ties"))
    na, nb = F.col("n_a"), F.col("n_b")
    u, n = F.col("ranks") - na * (na + 1) / 2, na + nb
    spread = F.sqrt(na * nb / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.abs(u - na * nb / 2) - 0.5) / spread
    return s.select("n_a", "n_b", u.alias("u"), F.abs(1 - 2 * u / (na * nb)).alias("rank_biserial"), F.when(spread > 0, F.greatest(z, F.lit(0.0))).alias("z"))


def cumulated(df: DataFrame, order: str, columns: list[str], parts: int = 64) -> DataFrame:
    """Adds before_<c>: the sum of c over rows of smaller order, whose values are distinct. Rows are dealt into parts at
    approximate quantiles (parts - 1 numbers on the driver) and summed within; the parts' totals are summed apart, so nothing
    is sorted in one task."""
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)])).first()[0] or []
    part = F.size(F.filter(F.array(*(F.lit(float(c)) for c in dict.fromkeys(cuts))), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    dealt = df.withColumn("__p", part)
    ahead = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    totals = dealt.groupBy("__p").agg(*(F.sum(c).alias(f"__t_{c}") for c in columns))
    totals = totals.select("__p", *(F.coalesce(F.sum(f"__t_{c}").over(ahead), F.lit(0)).alias(f"__o_{c}") for c in columns))
    inside = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__i_{c}") for c in columns))
    out = summed.join(F.broadcast(totals), "__p")
    return out.select(*df.columns, *((F.col(f"__i_{c}") + F.col(f"__o_{c}")).alias(f"before_{c}") for c in columns))


def compare_groups(df: DataFrame, value: str, group: str, a: object, b: object, parametric: bool = True) -> dict:
    """The t-test if parametric and both sides have two values, else the U test: name, statistic, p_value, effect."""
    t = t_test(df, value, group, a, b).first()
    if parametric and t["t"] is not None:
        return {"test": "t", "statistic": t["t"], "p_value": t_two_sided(t["t"], t["df"]), "effect": t["cohen_d"]}
    u = u_test(df, value, group, a, b).first()
    return {"test": "u", "statistic": u["u"], "p_value": normal_two_sided(u["z"] or 0.0), "effect": u["rank_biserial"]}


def compare_times(df: DataFrame, value: str, group: str, a: object, b: object) -> DataFrame:
    """One row: mean_a, mean_b, difference, percent (of b; infinite if that is 0), faster."""
    means = df.agg(*(F.avg(F.when(F.col(group) == x, F.col(value))).alias(n) for n, x in (("mean_a", a), ("mean_b", b))))
    gap = F.col("mean_a") - F.col("mean_b")
    percent = F.when(F.col("mean_b") == 0, F.lit(float("inf"))).otherwise(gap / F.nullif(F.col("mean_b"), F.lit(0.0)) * 100)
    return means.withColumns({"difference": gap, "percent": percent, "faster": F.when(gap < 0, F.lit(str(a))).otherwise(F.lit(str(b)))})


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, freedom: float) -> float:
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def t_quantile(p: float, freedom: float) -> float:
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - t_two_sided(middle, freedom) / 2 < p else (low, middle)
    return high


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
