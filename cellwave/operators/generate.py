"""Per-second traffic from the on/off arrival model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwave.functions import draws

#: Tasks a core that slots are dealt to before they grow.
TASKS_A_CORE = 4


def slot_draws(mu: np.ndarray, tau: np.ndarray, zeta: np.ndarray, rate: np.ndarray, psi: np.ndarray, names: list[tuple[int, int]], slot: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and arrivals, one row a slot. A slot's numbers depend on the seed and its name alone."""
    n = len(mu)
    moves, arrivals, values = np.zeros((n, slot + 1)), np.zeros((n, slot), np.int64), np.zeros((n, slot))
    for i, name in enumerate(names):
        rng = np.random.default_rng([seed & 0xFFFFFFFF, name[0] & 0xFFFFFFFFFFFFFFFF, name[1] & 0xFFFFFFFFFFFFFFFF])
        moves[i] = rng.random(slot + 1)
        arrivals[i] = rng.poisson(rate[i], slot)
        # the sum of k exponentials is one gamma draw
        values[i] = rng.standard_gamma(arrivals[i]) * psi[i]
    on = moves[:, 0] < 0.5
    for s in range(slot):
        u = moves[:, s + 1]
        on = np.where(on, u >= tau, u < zeta)
        off = ~on | (mu <= 0)
        arrivals[off, s], values[off, s] = 0, 0.0
    return values, arrivals


def generate_ipp(slots: DataFrame, slot: int = 300, seed: int = 0, sector: str = "secteur", start: str = "dates_5min", rows: int = 256) -> DataFrame:
    """sector, start, psi (array<double>) and arrivals (array<long>) of each slot, ``slot`` entries each.

    ``slots`` has tau, zeta, lambda, e_psi and slot_mu. Each second moves first
    (on to off below tau, off to on below zeta) and then, if on, draws a Poisson
    number of exponential demands. Slots are independent, seeded by sector and
    start, so results do not depend on how they are dealt; the caller deals
    them (``repartition(n, sector, start)``) before they grow ``slot``-fold.
    """
    picked = slots.select(F.col(sector).alias("sector"), F.col(start).alias("start"), F.xxhash64(F.col(sector).cast("string")).alias("h"), F.unix_micros(start).alias("t"), "slot_mu", "tau", "zeta", "lambda", "e_psi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                b = batch.iloc[at : at + rows]
                values, arrivals = slot_draws(*(b[c].to_numpy(float) for c in ("slot_mu", "tau", "zeta", "lambda", "e_psi")), list(zip(b["h"].tolist(), b["t"].tolist())), slot, seed)
                yield pd.DataFrame({"sector": b["sector"].to_numpy(), "start": b["start"].to_numpy(), "psi": list(values), "arrivals": list(arrivals)})

    schema = f"sector {picked.schema['sector'].dataType.simpleString()}, start timestamp, psi array<double>, arrivals array<long>"
    return picked.mapInPandas(run, schema).withColumnsRenamed({"sector": sector, "start": start})


def expand_seconds(slots: DataFrame, values: str = "psi", sector: str = "secteur", start: str = "dates_5min") -> DataFrame:
    """sector, timestamp, psi_instant: one row for each entry of a slot's array, a second apart."""
    each = slots.select(sector, start, F.posexplode(values).alias("s", "psi_instant"))
    return each.select(sector, (F.col(start) + F.make_dt_interval(secs=F.col("s"))).alias("timestamp"), "psi_instant")


def generate_seconds(slots: DataFrame, slot: int = 300, seed: int = 0, sector: str = "secteur", start: str = "dates_5min") -> DataFrame:
    """sector, start, second (from 1), timestamp, arrivals and psi_instant: ``slot`` rows for each slot, by column expressions alone.

    The model is that of ``generate_ipp``; ``slots`` has tau, zeta, lambda, e_psi
    and slot_mu. Every draw is named by the seed, the sector, the slot's start
    and the second, so any part of the traffic can be made again, anywhere, and
    comes out the same. A second whose number is below tau and zeta turns the
    state round, one between them sets it, others leave it. A slot's states are
    found in its own row, so nothing is sorted or shuffled once the slots,
    dealt by sector and start to several tasks a core, have grown; and only what
    a second needs is drawn for it.
    """
    keys = [F.col(sector).alias("sector"), F.col(start).alias("start")]
    tasks = TASKS_A_CORE * slots.sparkSession.sparkContext.defaultParallelism
    picked = slots.select(*keys, "slot_mu", "tau", "zeta", F.col("lambda").alias("rate"), "e_psi").repartition(tasks, "sector", "start")
    picked = picked.withColumn("table", draws.poisson_table(F.col("rate"))).withColumn("name", draws.name(seed, F.col("sector"), F.unix_micros("start")))
    picked = picked.withColumn("digits", F.transform(F.sequence(F.lit(0), F.lit(slot)), lambda second: draws.named(F.col("name"), second)))
    picked = picked.withColumn("moves", F.transform("digits", lambda d: draws.uniform(d)))

    def move(state: Column, u: Column) -> Column:
        off, on = u < F.col("tau"), u < F.col("zeta")
        now = F.when(off & on, ~state["on"]).when(off != on, on).otherwise(state["on"])
        return F.struct(now.alias("on"), F.concat(state["all"], F.when(now, "1").otherwise("0")).alias("all"))

    # a character a second, the first for second 0
    first = F.get("moves", F.lit(0)) < 0.5
    begun = F.struct(F.coalesce(first, F.lit(False)).alias("on"), F.lit("-").alias("all"))
    picked = picked.withColumn("states", F.aggregate(F.slice("moves", 2, slot), begun, move, lambda state: state["all"])).drop("moves")
    each = picked.withColumn("second", F.explode(F.sequence(F.lit(0), F.lit(slot)))).filter("second > 0")
    active = (F.substring("states", F.col("second") + 1, F.lit(1)) == "1") & (F.col("slot_mu") > 0)
    each = each.withColumn("active", active).withColumn("u", F.when(F.col("active"), draws.uniform(F.get("digits", F.col("second")), 1))).drop("digits", "states")
    each = each.withColumn("w", F.when(F.col("active") & (F.col("rate") > draws.POISSON_SUMMED), draws.normal_quantile(F.col("u"))))
    drawn = draws.poisson(F.col("u"), F.col("w"), F.col("rate"), F.col("table"))
    counted = each.withColumn("arrivals", F.when(F.col("active"), drawn).otherwise(F.lit(0).cast("long"))).drop("table")
    name, many = [F.col("name"), F.col("second")], F.col("arrivals") > draws.GAMMA_SUMMED
    counted = counted.withColumn("one", F.when(many, draws.uniform(draws.named(*name, 0)))).withColumn("z", F.when(many, draws.normal_quantile(F.col("one"))))
    value = F.when(F.col("arrivals") > 0, draws.exponential_sum(F.col("arrivals"), F.col("z"), name) * F.col("e_psi")).otherwise(0.0)
    timestamp = F.col("start") + F.make_dt_interval(secs=F.col("second") - 1)
    return counted.select(F.col("sector").alias(sector), F.col("start").alias(start), "second", timestamp.alias("timestamp"), "arrivals", value.alias("psi_instant"))
