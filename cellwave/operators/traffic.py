"""The on/off arrival model: fit of its rates and parameters of its slots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwave.functions.search import constant_table, nearest

#: Points of either axis of the grid, and its ends.
POINTS, LOW, HIGH = 40, 0.05, 1.0
#: What a sector without positive mean and variance gets.
DEFAULT_TAU, DEFAULT_ZETA, DEFAULT_RATIO = 0.1, 0.5, 0.1


def axis() -> np.ndarray:
    return np.linspace(LOW, HIGH, POINTS)


def cell_of(i: Column, slot: int) -> tuple[Column, Column, Column]:
    """tau, zeta and least ratio of cell ``i``; cells go in the order tau, zeta."""
    step = (HIGH - LOW) / (POINTS - 1)

    def at(k: Column) -> Column:
        return F.when(k == POINTS - 1, F.lit(HIGH)).otherwise(k * F.lit(step) + F.lit(LOW))

    tau, zeta = at(F.floor(i / POINTS)), at(i % POINTS)
    return tau, zeta, (2 * zeta) / (tau * slot * (tau + zeta))


def grid(spark: SparkSession, slot: int = 300) -> DataFrame:
    """All (idx, tau, zeta, min_ratio) of the grid. Its size is fixed: 1,600 rows."""
    tau, zeta, least = cell_of(F.col("id"), slot)
    return spark.range(POINTS * POINTS).select(F.col("id").alias("idx"), tau.alias("tau"), zeta.alias("zeta"), least.alias("min_ratio"))


def fit_tau_zeta(stats: DataFrame, slot: int = 300) -> DataFrame:
    """tau, zeta and ratio of each row of ``stats`` (mu, var): the cell whose least ratio is nearest to var / mu ** 2, the first of equals.

    Where mu or var is not positive: the defaults; where var is null: the
    default rates and a null ratio. The cells' ratios depend on no data, so
    they are a sorted table of constants, in which a search by halving replaces
    the comparison with all 1,600: no join, no Python, no shuffle.
    """
    values = axis()
    tau, zeta = np.repeat(values, POINTS), np.tile(values, POINTS)
    least = (2 * zeta) / (tau * slot * (tau + zeta))
    order = np.argsort(least, kind="stable")
    fits = (F.col("mu") > 0) & (F.col("var") > 0)
    ratio = F.col("var") / (F.col("mu") * F.col("mu"))
    points = constant_table(values.tolist())
    cell = nearest(F.when(fits, ratio), least[order].tolist(), order.tolist())
    no_ratio = F.col("var").isNull() & (F.coalesce("mu", F.lit(1.0)) > 0)
    return (
        stats.withColumn("_cell", cell)
        .withColumn("ratio", F.when(fits, ratio).when(no_ratio, F.lit(None).cast("double")).otherwise(DEFAULT_RATIO))
        .withColumn("tau", F.coalesce(F.get(points, F.floor(F.col("_cell") / POINTS).cast("int")), F.lit(DEFAULT_TAU)))
        .withColumn("zeta", F.coalesce(F.get(points, F.col("_cell") % POINTS), F.lit(DEFAULT_ZETA)))
        .drop("_cell")
    )


def fit_tau_zeta_sql(stats: DataFrame, keys: list[str], slot: int = 300) -> DataFrame:
    """keys, tau, zeta by comparing every row with all 1,600 cells, which an array of the row holds: the plain form of the fit, to test the other against."""
    ratio = F.col("var") / (F.col("mu") * F.col("mu"))

    def cell(i):
        tau, zeta, least = cell_of(i, slot)
        return F.struct(F.abs(ratio - least).alias("err"), i.alias("idx"), tau.alias("tau"), zeta.alias("zeta"))

    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(POINTS * POINTS - 1)), cell))
    return stats.filter("mu > 0 and var > 0").withColumn("_best", best).select(*keys, "_best.tau", "_best.zeta")


def slot_variance(df: DataFrame, stats: DataFrame, sector: str = "secteur", value: str = "trafic_mbps") -> DataFrame:
    """slot_mu (the traffic seen) and slot_var = cv2 * slot_mu ** 2 of every slot, from its sector's cv2. Slots without traffic vanish."""
    seen = df.filter(F.col(value).isNotNull()).withColumn("slot_mu", F.col(value).cast("double"))
    return seen.join(stats, sector).withColumn("slot_var", F.col("cv2") * F.col("slot_mu") * F.col("slot_mu"))


TINY = 1e-6


def arrival_params(df: DataFrame, slot: int = 300, mu: str = "slot_mu", var: str = "slot_var") -> DataFrame:
    """lambda and e_psi of rows with mu, var, tau and zeta."""
    m, v, tau, zeta = F.col(mu), F.col(var), F.col("tau"), F.col("zeta")
    least = (2 * zeta) / (tau * slot * (tau + zeta))
    ratio = v / (m * m)
    ratio = F.when(ratio <= least, least + TINY).otherwise(ratio)
    span = tau * slot * (ratio - least)
    rate = (tau + zeta) / F.when(span > 0, span).otherwise(TINY)
    rate = F.when(rate > 0, rate).otherwise(TINY)
    positive = df.withColumn("lambda", F.when(m <= 0, F.lit(TINY)).otherwise(rate))
    size = (tau + zeta) * m / (tau * F.col("lambda") * slot)
    return positive.withColumn("e_psi", F.when((m <= 0) | ~(size > 0), F.lit(TINY)).otherwise(size))


def model_moments(df: DataFrame, slot: int = 300, var_psi=None) -> DataFrame:
    """The model's moments from tau, zeta, lambda and e_psi: e_u, var_u, e_total, var_total. Demands are exponential unless ``var_psi`` is given."""
    tau, zeta, rate, psi = (F.col(c) for c in ("tau", "zeta", "lambda", "e_psi"))
    spread = psi * psi if var_psi is None else var_psi
    out = df.withColumn("e_u", rate * (tau / (tau + zeta)) * slot)
    out = out.withColumn("var_u", F.col("e_u") * (1 + 2 * rate * zeta / ((tau + zeta) * (tau + zeta))))
    return out.withColumn("e_total", F.col("e_u") * psi).withColumn("var_total", F.col("e_u") * spread + F.col("var_u") * psi * psi)
