"""Emotion: baselines, decayed statistics, arcs and the sequential filter. Observations are (owner_id, obs_id, dim, y, t)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

#: Fixed values of the model: prior mean and spread, shrinkage, noise, half-lives.
PRIOR_MU, PRIOR_SIGMA, SLOT_N0, USER_N0 = 0.2, 0.15, 8, 10
OBS_NOISE, TAU_HOURS, ANOMALY_SIGMA, MIN_SAMPLES, MIN_SIGMA, NOISE_FLOOR = 0.07, 6.0, 2.0, 50, 0.03, 0.2
HALF_LIFE_DAYS, RATE_STRENGTH, RATE_PRIOR = 30.0, 3.0, 0.1
ROBUST_K, ROBUST_CORRECTION = 2.0, 1 / 0.9205


def decayed_stats(events: DataFrame, keys: list[str], half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """n, hits and mag of each key at its last event: sums of 2^-(age / half-life), whatever the order of arrival."""
    last = events.groupBy(*keys).agg(F.max("t").alias("last_at"))
    fade = F.pow(F.lit(2.0), -(F.unix_micros("last_at") - F.unix_micros("t")) / F.lit(86400e6 * half_life_days))
    aged = events.join(last, keys).withColumn("_w", fade)
    return aged.groupBy(*keys, "last_at").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("hit")).alias("hits"), F.sum(F.col("_w") * F.col("mag")).alias("mag"))


def rates(stats: DataFrame, now: Column, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """Bayesian-averaged rate of each key and its lift over the dimension's own; statistics are faded to ``now`` first."""
    fade = F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("last_at")) / F.lit(86400e6 * half_life_days)))
    f = stats.withColumns({c: F.col(c) * fade for c in ("n", "hits", "mag")})
    w = Window.partitionBy("dim")
    p0 = (F.sum("hits").over(w) + RATE_STRENGTH * RATE_PRIOR) / (F.sum("n").over(w) + RATE_STRENGTH)
    f = f.withColumn("p0", p0)
    rate = (F.col("hits") + RATE_STRENGTH * F.col("p0")) / (F.col("n") + RATE_STRENGTH)
    return f.withColumns({"rate": rate, "lift": rate / F.col("p0")})


def topic_slots(events: DataFrame) -> DataFrame:
    """Mean of y by topic and time of day, faded; events are (category, slot, dim, y, t)."""
    s = decayed_stats(events.withColumns({"hit": F.lit(0.0), "mag": F.col("y")}), ["category", "slot", "dim"])
    return s.select("category", "slot", "dim", "n", (F.col("mag") / F.col("n")).alias("mean"))


def sums_in_order(obs: DataFrame, keys: list[str]) -> DataFrame:
    """n and s of each key: a sum of doubles depends on the order of its terms, which is that of obs_id here. Rows pass one by one."""
    w = Window.partitionBy(*keys).orderBy("obs_id").rowsBetween(Window.unboundedPreceding, 0)
    running = obs.select(*keys, F.count(F.lit(1)).over(w).alias("_n"), F.sum("y").over(w).alias("_s"))
    return running.groupBy(*keys).agg(F.max("_n").alias("n"), F.max_by("_s", "_n").alias("s"))


def baselines(obs: DataFrame, decimals: bool = True) -> DataFrame:
    """Mean of each (owner, dim, slot), shrunk to the owner's, which is shrunk to the prior; unweighted closed form. Sums are of twelve
    decimals, so that they don't depend on the order of their terms, or else of doubles in the order of obs_id and slot."""
    keys = ["owner_id", "dim", "slot"]
    if decimals:
        slots = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("decimal(25,12)")).alias("s"))
    else:
        slots = sums_in_order(obs, keys)
    w = Window.partitionBy("owner_id", "dim").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    overall = (F.sum("s").over(w).cast("double") + USER_N0 * PRIOR_MU) / (F.sum("n").over(w) + USER_N0)
    return slots.withColumn("overall", overall).withColumn("s", F.col("s").cast("double")).withColumn("mu", (F.col("s") + SLOT_N0 * F.col("overall")) / (F.col("n") + SLOT_N0))


def event_arcs(df: DataFrame) -> DataFrame:
    """Means of y before and on or after each event's day, and their difference; df is (event, event_at, t, y)."""
    after = F.to_date("t") >= F.col("event_at")
    g = df.groupBy("event", "event_at").agg(F.avg(F.when(~after, F.col("y"))).alias("before"), F.avg(F.when(after, F.col("y"))).alias("after"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("delta", F.col("after") - F.col("before"))


def high_days(df: DataFrame, least_weight: float = 0.6, least: int = 3, newest: int = 5) -> DataFrame:
    g = df.filter(F.col("emotional_weight") >= least_weight).groupBy("owner_id", F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("emotional_weight").alias("mean"))
    rank = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("day"))).cast("long")
    return g.filter(F.col("n") >= least).withColumn("rank", rank).filter(F.col("rank") <= newest)


def anniversaries(df: DataFrame, now: Column, zone: str) -> DataFrame:
    """Rows whose local month and day are today's, of an earlier year."""
    local, today = F.from_utc_timestamp("created_at", zone), F.from_utc_timestamp(now, zone)
    return df.filter((F.date_format(local, "MM-dd") == F.date_format(today, "MM-dd")) & (F.year(local) < F.year(today)))


def sanitise(scores: Column, aliases: dict[str, str], dims: list[str]) -> Column:
    """Map of text to text, as a map of known dimensions to numbers in 0..1; null if no key is known, empty if there is none."""
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    pairs = F.transform(F.map_entries(scores), lambda e: F.struct(F.coalesce(F.try_element_at(names, F.lower(e["key"])), F.lower(e["key"])).alias("k"), F.lower(e["value"]).try_cast("double").alias("v")))
    known = F.filter(pairs, lambda p: p["k"].isin(dims) & p["v"].isNotNull())
    clamped = F.transform(known, lambda p: F.struct(p["k"].alias("k"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p["v"])).alias("v")))
    best = F.transform(F.array_distinct(F.transform(clamped, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), F.array_max(F.transform(F.filter(clamped, lambda p: p["k"] == k), lambda p: p["v"])).alias("v")))
    return F.when(F.size(scores) == 0, F.create_map().cast("map<string,double>")).when(F.size(known) > 0, F.map_from_entries(best))


def pulled(mean: float, n: float, to: float, strength: float) -> float:
    """A mean of n observations, pulled to a prior that counts as ``strength`` of them."""
    return (n * mean + strength * to) / (n + strength)


def drifted(x: float, p: float, mu: float, s2: float, keep: float) -> tuple[float, float]:
    """Mean and variance of a mean-reverting process of stationary variance s2, of whose distance to mu the share ``keep`` is left."""
    return mu + keep * (x - mu), keep**2 * p + (1 - keep**2) * s2


def seen(x: float, p: float, y: float, noise: float) -> tuple[float, float]:
    """The posterior of a normal state after an observation with that noise variance."""
    precision = 1 / p + 1 / noise
    return (x / p + y / noise) / precision, 1 / precision


def level(y: float, x: float | None, p: float, s2: float, noise: float, keep: float) -> tuple[float, float] | None:
    """What an observation says of the level that the process reverts to, and with which precision: y = level + keep (x - level) + errors.
    None where too little of the old state is gone."""
    if x is None:
        return y, 1 / (s2 + noise)
    gone = 1 - keep
    if gone < LEAST_GONE:
        return None
    return (y - keep * x) / gone, gone**2 / ((1 - keep**2) * s2 + noise + keep**2 * p)


#: Share of the old state that must be gone before an observation says anything of the level.
LEAST_GONE = 0.05


class Baseline:
    """A person's level of one dimension by time of day, and the state around it: one step for each observation in order."""

    def __init__(self, state: dict | None = None) -> None:
        #: By slot: how many observations it counts as, their precisions, and the precision-weighted sum of levels.
        self.levels: dict[str, list[float]] = dict((state or {}).get("levels", {}))
        #: Residuals: number and winsorised squares. The state's mean, variance and time.
        self.residuals: list[float] = list((state or {}).get("residuals", (0, 0.0)))
        self.at: list[float] | None = (state or {}).get("at")

    def state(self) -> dict:
        return {"levels": self.levels, "residuals": self.residuals, "at": self.at}

    def usual(self, slot: str) -> float:
        """The slot's level, pulled to the person's, which is pulled to everybody's."""
        n, w, s = (sum(x) for x in zip(*self.levels.values(), strict=True)) if self.levels else (0, 0, 0)
        person = pulled(s / w if w > 0 else PRIOR_MU, n, PRIOR_MU, USER_N0) if n > 0 else PRIOR_MU
        n, w, s = self.levels.get(slot, (0, 0, 0))
        return pulled(s / w if w > 0 else person, n, person, SLOT_N0) if n > 0 else person

    def variance(self) -> float:
        """The process's variance: the residuals' less the observation's noise, pulled to everybody's."""
        n, squares = self.residuals
        own = max(squares / n * ROBUST_CORRECTION - OBS_NOISE**2, MIN_SIGMA**2) if n else 0.0
        return max(pulled(own, n, PRIOR_SIGMA**2, USER_N0), MIN_SIGMA**2)

    def step(self, y: float, hours: float, slot: str) -> tuple[float, float, float, bool, bool]:
        """(z, level, state's mean, anomaly, still learning); the observation is learned from afterwards."""
        told, y = y > NOISE_FLOOR, max(y, NOISE_FLOOR)
        mu, s2, noise = self.usual(slot), self.variance(), OBS_NOISE**2
        spread, learning = math.sqrt(s2 + noise), self.residuals[0] < MIN_SAMPLES
        z = (y - mu) / spread
        x, p, then = self.at or (None, 0.0, hours)
        keep = math.exp(-max(0.0, hours - then) / TAU_HOURS)
        says = level(y, x, p, s2, noise, keep)
        before = (mu, s2) if x is None else drifted(x, p, mu, s2, keep)
        self.at = [*seen(*before, y, noise), hours]
        row = self.levels.setdefault(slot, [0.0, 0.0, 0.0])
        if says is not None:
            mean, precision = says
            row[:] = row[0] + min(1.0, precision * (s2 + noise)), row[1] + precision, row[2] + precision * mean
        most = ROBUST_K * spread
        self.residuals = [self.residuals[0] + 1, self.residuals[1] + max(-most, min(most, y - mu)) ** 2]
        return z, mu, self.at[0], told and z >= ANOMALY_SIGMA, learning


RUN = "owner_id long, dim string, obs_id long, z double, mu double, x double, anomaly boolean, learning boolean"


def with_slot(obs: DataFrame, zone: str = "UTC") -> DataFrame:
    return obs.withColumn("slot", t.day_slot(F.hour(F.from_utc_timestamp("t", zone))))


def replay(obs: DataFrame) -> DataFrame:
    """Every observation's z against the personal baseline of all before it, in time order. The filter is a true fold, so an
    (owner, dim) is one sorted run; a partition streams through its runs and holds one state at a time, never a group."""
    ordered = with_slot(obs).select("owner_id", "dim", "obs_id", "y", "slot", (F.unix_micros("t") / F.lit(3.6e9)).alias("hours"))
    return ordered.repartition("owner_id", "dim").sortWithinPartitions("owner_id", "dim", "hours", "obs_id").mapInPandas(_fold, RUN)


def _fold(batches):
    import pandas as pd

    key, state = None, Baseline()
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if (r.owner_id, r.dim) != key:
                key, state = (r.owner_id, r.dim), Baseline()
            out.append((r.owner_id, r.dim, r.obs_id, *state.step(r.y, r.hours, r.slot)))
        yield pd.DataFrame(out, columns=["owner_id", "dim", "obs_id", "z", "mu", "x", "anomaly", "learning"])
