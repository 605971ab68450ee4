"""Bootstrap intervals, seeded controls and nearest profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .agg import ratio


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of a digest of the keys: the same for the same keys, wherever it is computed."""
    digest = F.md5(F.concat_ws(":", *(k.cast("string") for k in keys)).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def uniform_sql(*keys: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 12) AS BIGINT) / {float(1 << 48)}::DOUBLE)"


def _poisson() -> list[float]:
    """The shares of Poisson(1) up to 0, 1, ... 7."""
    total, term, out = 0.0, 0.36787944117144233, []
    for k in range(8):
        total += term
        out.append(total)
        term /= k + 1
    return out


def poisson_weight(*keys: Column) -> Column:
    """A Poisson(1) draw from a digest of the keys."""
    return F.get(F.transform(F.array(uniform(*keys)), lambda u: sum((F.when(u >= t, 1).otherwise(0) for t in _poisson()), F.lit(0))), 0)


def poisson_sql(*keys: str) -> str:
    return f"len([t FOR t IN [{', '.join(f'{t!r}::DOUBLE' for t in _poisson())}] IF {uniform_sql(*keys)} >= t])"


def bootstrap_difference(df: DataFrame, cluster: str, treated: str, outcome: str, replicates: int, seed: int = 1, group: list[str] | None = None) -> DataFrame:
    """(group, diff, low, high, ratio, ratio_low, ratio_high): difference and ratio of mean outcomes and their 95 % percentile intervals.

    Whole clusters are drawn. Sums per cluster come first, so what is multiplied by the replicates
    is one row per cluster; replicates are reduced by partial aggregation.
    """
    group = group or []
    t, y = F.col(treated).cast("boolean"), F.col(outcome).cast("double")
    one = lambda c: F.sum(F.when(c, y)), lambda c: F.sum(F.when(c & y.isNotNull(), 1).otherwise(0))
    per = df.groupBy(*group, cluster).agg(one[0](t).alias("sy"), one[1](t).alias("n"), one[0](~t).alias("sy0"), one[1](~t).alias("n0"))
    sums = lambda w: [F.sum(F.coalesce(F.col(c), F.lit(0)) * w).alias(c) for c in ("sy", "n", "sy0", "n0")]
    means = [ratio(F.col(y).cast("double"), F.col(n).cast("double")) for y, n in (("sy", "n"), ("sy0", "n0"))]
    gap, times = means[0] - means[1], ratio(means[0], means[1])
    once = per.groupBy(*group).agg(*sums(F.lit(1))).select(*group, gap.alias("diff"), times.alias("ratio"))
    drawn = per.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).groupBy(*group, "b").agg(*sums(poisson_weight(F.col(cluster), F.col("b"), F.lit(seed))))
    ends = lambda c: F.percentile(F.col(c), F.array(F.lit(0.025), F.lit(0.975)))
    spread = drawn.select(*group, gap.alias("g"), times.alias("r")).groupBy(*group).agg(ends("g").alias("e"), ends("r").alias("f"))
    spread = spread.select(*group, *(F.get(c, F.lit(i)).alias(name) for c, i, name in (("e", 0, "low"), ("e", 1, "high"), ("f", 0, "ratio_low"), ("f", 1, "ratio_high"))))
    out = once.join(spread, group) if group else once.crossJoin(spread)  # of one row each
    return out.select(*group, "diff", "low", "high", "ratio", "ratio_low", "ratio_high")


def bootstrap_sql(rows: str, cluster: str, treated: str, outcome: str, replicates: int, seed: int, group: list[str] | None = None) -> str:
    """WITH items that end in ``spread``: what ``bootstrap_difference`` gives of a relation."""
    g = "".join(f"{c}, " for c in group or [])
    by = f" GROUP BY {g.rstrip(', ')}" if g else ""
    on = " AND ".join(f"o.{c} = s.{c}" for c in group or []) or "true"
    sums = "sum(coalesce(sy, 0) * {w}) AS sy, sum(n * {w}) AS n, sum(coalesce(sy0, 0) * {w}) AS sy0, sum(n0 * {w}) AS n0"
    return f"""boot_clusters AS (SELECT {g}{cluster} AS c, sum(CAST({outcome} AS DOUBLE)) FILTER ({treated}) AS sy, count({outcome}) FILTER ({treated}) AS n, sum(CAST({outcome} AS DOUBLE)) FILTER (NOT {treated}) AS sy0, count({outcome}) FILTER (NOT {treated}) AS n0 FROM {rows} GROUP BY {g}{cluster}),
boot_once AS (SELECT {g}sy / nullif(n, 0) - sy0 / nullif(n0, 0) AS diff, (sy / nullif(n, 0)) / nullif(sy0 / nullif(n0, 0), 0) AS ratio FROM (SELECT {g}{sums.format(w=1)} FROM boot_clusters{by})),
boot_drawn AS (SELECT {g}b, {sums.format(w='w')} FROM (SELECT *, {poisson_sql('c', 'b', str(seed))} AS w FROM boot_clusters, range(1, {replicates + 1}) AS t(b)) GROUP BY {g}b),
boot_ends AS (SELECT {g}quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, quantile_cont(r, 0.025) AS ratio_low, quantile_cont(r, 0.975) AS ratio_high
  FROM (SELECT {g}sy / nullif(n, 0) - sy0 / nullif(n0, 0) AS d, (sy / nullif(n, 0)) / nullif(sy0 / nullif(n0, 0), 0) AS r FROM boot_drawn){by}),
spread AS (SELECT o.*, s.low, s.high, s.ratio_low, s.ratio_high FROM boot_once o JOIN boot_ends s ON {on})"""


def controls(events: DataFrame, pool: DataFrame, on: list[str], event: str, key: str, k: int, seed: int = 1, apart: DataFrame | None = None, most: int = 0, own: str | None = None, block: int = 20_000) -> DataFrame:
    """k seeded draws from the pool rows of the same ``on`` for each event; the same on every run.

    Pool rows and events are placed on a ring by digests of their names; an event takes the pool
    rows that follow it. Places on the ring are numbered within arcs of about ``block`` rows, arcs
    by their counts, so an event meets its controls by number, not the whole pool. ``own``: the
    event's own key, which it never draws; ``apart``: pairs (event, key) that it never draws either,
    ``most`` an event at most.
    """
    at = lambda *keys: uniform(F.lit(seed), *keys)
    sizes = pool.groupBy(*on).agg(F.count("*").alias("_all"), F.ceil(F.count("*") / block).cast("int").alias("_arcs"))
    rows = pool.select(*on, F.col(key), F.lit(None).cast(events.schema[event].dataType).alias("_event"), at(F.lit("pool"), F.col(key)).alias("_at"))
    asked = events.select(*on, F.lit(None).cast(pool.schema[key].dataType).alias(key), F.col(event).alias("_event"), at(F.lit("event"), F.col(event)).alias("_at"))
    ring = rows.unionByName(asked).join(sizes, on).withColumn("_arc", F.floor(F.col("_at") * F.col("_arcs")).cast("int"))
    so_far = Window.partitionBy(*on, "_arc").orderBy("_at", F.col("_event").isNotNull(), key, "_event").rowsBetween(Window.unboundedPreceding, 0)
    ring = ring.withColumn("_n", F.count(key).over(so_far))
    lengths = ring.groupBy(*on, "_arc").agg(F.count(key).alias("_c"))
    every = sizes.select(*on, F.explode(F.sequence(F.lit(0), F.col("_arcs") - 1)).alias("_arc")).join(lengths, [*on, "_arc"], "left")
    along = Window.partitionBy(*on).orderBy("_arc").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(*on, "_arc", F.coalesce(F.sum("_c").over(along), F.lit(0)).alias("_before"))
    ring = ring.join(every, [*on, "_arc"]).withColumn("_place", F.col("_before") + F.col("_n"))
    reach = F.least(F.lit(k + most + (1 if own else 0)), F.col("_all"))
    asked = ring.filter(F.col("_event").isNotNull()).select(*on, "_event", "_place", "_all", F.explode(F.sequence(F.lit(1), reach)).alias("_step"))
    asked = asked.select(*on, F.col("_event").alias(event), "_step", ((F.col("_place") + F.col("_step") - 1) % F.col("_all") + 1).alias("_place"))
    drawn = asked.join(ring.filter(F.col("_event").isNull()).select(*on, key, "_place"), [*on, "_place"])
    if own:
        drawn = drawn.join(events.select(event, F.col(own).alias("_own")), event).filter(F.col(key) != F.col("_own")).drop("_own")
    if apart is not None:
        drawn = drawn.join(apart.select(event, key), [event, key], "left_anti")
    first = F.row_number().over(Window.partitionBy(event).orderBy("_step"))
    return drawn.withColumn("_rn", first).filter(F.col("_rn") <= k).select(*on, event, key)


def _nearest_of(asks: pd.DataFrame, rows: pd.DataFrame, on: list[str], event: str, key: str, width: int, k: int, least: int) -> pd.DataFrame:
    """The k rows nearest to each of ``asks``, gap by gap in the features' order."""
    out = []
    rows = rows.sort_values(key, kind="stable")
    names, kinds = rows[key].to_numpy(), rows["_same"].to_numpy()
    x, there = _matrix(rows, width)
    q, asked = _matrix(asks, width)
    whole = there.all(axis=0)
    alike = len(set(kinds)) == 1
    for at, (own, kind) in enumerate(zip(asks[event], asks["_same"])):
        total, n = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        for f in range(width):
            if asked[at, f]:
                gap = x[f] - q[f, at]
                gap *= gap
                total += gap if whole[f] else np.where(there[:, f], gap, 0.0)
                n += 1 if whole[f] else there[:, f]
        able = (n >= least) & (names != own)
        other = np.zeros(len(rows), np.int64) if alike and kind is not None and kinds[0] == kind else np.array([2 if kind is None or o is None else int(o != kind) for o in kinds])
        left = k
        for c in np.unique(other[able]):
            lot = np.flatnonzero(able & (other == c))
            distance = np.sqrt(total[lot] / n[lot])
            if len(lot) > left:  # with all that tie
                near = np.flatnonzero(~(distance > np.partition(distance, left - 1)[left - 1]))
                lot, distance = lot[near], distance[near]
            best = np.argsort(distance, kind="stable")[:left]
            out += [(at, lot[b], int(n[lot[b]]), distance[b], int(c)) for b in best]
            left -= len(best)
            if not left:
                break
    at, row = (np.array([o[i] for o in out], np.int64) for i in (0, 1))
    found = asks[[*on, event]].iloc[at].reset_index(drop=True)
    return found.assign(**{key: names[row], "n": [o[2] for o in out], "distance": [o[3] for o in out], "_other": [o[4] for o in out]})


def _matrix(frame: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature by row, row by feature: is there)."""
    x = np.ascontiguousarray(np.array(frame["_x"].tolist(), float).reshape(-1, width).T)
    there = np.ones((len(frame), width), bool, order="F")
    for i, gone in enumerate(frame["_gone"]):
        there[i, list(gone)] = False
    return x, there


def nearest_profiles(events: DataFrame, pool: DataFrame, on: list[str], event: str, key: str, features: list[str], k: int, least: int = 3, same: str | None = None, block: int = 20_000) -> DataFrame:
    """The k pool rows nearest to each event within ``on``: root mean square over the features that
    both have (``least`` or more), rows of the same ``same`` first, rows without one last.

    An event first meets the rows of its own ``same``; only events that find fewer than k there meet
    the whole of ``on``. They go to every block of these rows (``block`` rows, about) once, each block
    keeps its k nearest, and only those meet again.
    """
    profile = lambda df, own: df.dropna(subset=[*on, own]).select(
        *(F.col(c).alias(c) for c in [*on, own]), F.col(same).cast("string").alias("_same") if same else F.lit("").alias("_same"), F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features)).alias("_x"),
        F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(features)))).alias("_gone"))
    asked, rows = cut(profile(events, event)), cut(profile(pool, key))
    fields = {c: events.schema[c].dataType for c in [*on, event]} | {key: pool.schema[key].dataType}
    out = T.StructType([*(T.StructField(c, t) for c, t in fields.items()), T.StructField("n", T.IntegerType()), T.StructField("distance", T.DoubleType()), T.StructField("_other", T.IntegerType())])

    def met(asked: DataFrame, by: list[str]) -> DataFrame:
        sizes = rows.groupBy(*by).agg(F.count("*").alias("_all")).select(*by, F.greatest(F.ceil(F.col("_all") / block), F.least(F.lit(16), F.ceil(F.col("_all") / 1_000))).cast("int").alias("_blocks"))
        placed = rows.join(sizes, by).select(*rows.columns, F.pmod(F.xxhash64(key), "_blocks").alias("_b"))
        asks = asked.join(sizes, by).select(*asked.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks").cast("bigint") - 1)).alias("_b"))
        meet = lambda a, r: _nearest_of(a, r, on, event, key, len(features), k, least)
        best = asks.groupBy(*by, "_b").cogroup(placed.withColumn("_b", F.col("_b").cast("bigint")).groupBy(*by, "_b")).applyInPandas(meet, out).withColumn("distance", F.coalesce("distance", F.lit(float("nan"))))  # pandas hands NaN back as null
        rank = F.row_number().over(Window.partitionBy(event).orderBy("_other", "distance", key))
        return best.withColumn("rank", rank).filter(F.col("rank") <= k).drop("_other")

    columns = [*on, event, key, "n", "distance", "rank"]
    if not same:
        return met(asked, on).select(*columns)
    own = cut(met(asked.dropna(subset=["_same"]), [*on, "_same"]))
    full = own.filter(F.col("rank") == k).select(event)
    short = cut(asked.join(full, event, "left_anti"))
    if short.isEmpty():
        return own.select(*columns)
    return own.join(full, event, "left_semi").select(*columns).unionByName(met(short, on).select(*columns))
