"""Group statistics over the chain, attached to every row of the group.

Statistics are aggregated first and joined back: a group's rows never meet in one task, and the joined side has one row per group. `keys` always
starts with snapshot_date, so that many snapshots go through one job. Statistics are taken from `source` where it is given: a frame of the same
rows from before other statistics were joined, so that a chain of these functions does not repeat the joins below it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeline.functions import ranks
from strikeline.functions.graph import Definitions
from strikeline.params import Params

SNAPSHOT = ("snapshot_date",)
UNDERLYING = [*SNAPSHOT, "underlying_symbol"]
SIDE = [*UNDERLYING, "option_type"]
EXPIRATION = [*UNDERLYING, "expiration_date"]


def attach(chain: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that match where both are missing too; Spark broadcasts the statistics where their size allows it."""
    named = stats.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = None
    for k in keys:
        test = chain[k].eqNullSafe(named[f"_k_{k}"])
        on = test if on is None else on & test
    return chain.join(named, on, "left").drop(*(f"_k_{k}" for k in keys))


def quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float], store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Quantiles of the values of each group, interpolated between neighbours, and `_n`, the number of values that are not missing.

    Buckets of values are summed up (ranks), and values are ranked only in those buckets that hold a wanted place, so a group of many different values is not one task.
    Values are counted first, so a hot group comes as its different values and counts. With `store`, for rows that are cheap to read twice and whose values mostly differ, the
    buckets come from the rows themselves and the wanted ones are stored, so that Spark sends them to the rows: only rows of those buckets are shuffled.
    """
    # a missing value counts 0; it is not filtered, since a filter would be rewritten in terms of all that a derived value is made of
    values = rows.select(*keys, F.col(value).alias("_value"))
    if store is None:
        counts = values.groupBy(*keys, "_value").agg(F.count("_value").alias("_c"))
    else:
        counts = values.withColumn("_c", F.when(F.col("_value").isNotNull(), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    bucket, n = ranks.bucket(F.col("_value"), ranks.PER_DOUBLING if store is None else ranks.FEW), F.col("_total")
    place = lambda q, n: q * (n - 1)
    holds = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_sum"))
    wanted = n == 0  # a group without values keeps its row
    for q in at.values():
        wanted = wanted | holds(F.floor(place(q, n))) | holds(F.ceil(place(q, n)))
    sums = ranks.sums_before(counts, keys, bucket, F.col("_c")).where(wanted)
    parts = ranks.join_buckets(counts, keys, bucket, sums if store is None else store(sums))
    if store is not None:
        parts = parts.groupBy(*keys, "_bucket", "_before", "_total", "_value").agg(F.sum("_c").alias("_c"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_bucket").orderBy("_value"))
    ranked = parts.select(*keys, "_value", upto.alias("_upto"), n.alias("_n"))
    n = F.col("_n")
    out = [F.max("_n").alias("_n")]
    for name, q in at.items():
        out += [F.min(F.when(F.col("_upto") > f(place(q, n)), F.col("_value"))).alias(f"_{k}_{name}") for k, f in (("low", F.floor), ("high", F.ceil))]
    stats = ranked.groupBy(*keys).agg(*out)
    low, high = (lambda name: F.col(f"_low_{name}")), (lambda name: F.col(f"_high_{name}"))
    above = lambda q: place(q, n) - F.floor(place(q, n))
    mixed = lambda name, q: F.when(low(name) == high(name), low(name)).otherwise((F.ceil(place(q, n)) - place(q, n)) * low(name) + above(q) * high(name))
    return stats.select(*keys, "_n", *(mixed(name, q).alias(name) for name, q in at.items()))


def iv_levels(source: DataFrame) -> DataFrame:
    """snapshot_date, underlying_symbol, iv_state_level: volatility level of each underlying: its nearest at-the-money volatility against the 30th and 70th percentile of all above 0.

    UNKNOWN with fewer than five volatilities. The representative is that of the least strike distance at the nearest expiration that has
    both; without one, the median. Ties: call before put, then strike, then symbol.
    """
    keys = [*SNAPSHOT, "underlying_symbol"]
    iv = F.when(F.col("implied_volatility") > 0, F.col("implied_volatility"))
    order = F.when(iv.isNotNull() & F.col("strike_distance_pct").isNotNull() & F.col("expiration_date").isNotNull(), F.struct("expiration_date", "strike_distance_pct", "option_type", "strike", "contract_symbol"))
    rows = source.select(*keys, iv.alias("_iv"), order.alias("_order"))
    found = quantiles(rows, keys, "_iv", {"_p30": 0.3, "_p70": 0.7, "_p50": 0.5})
    # next to a collected set, which is of nothing, Spark hashes the groups; alone, the struct makes it sort all rows
    near = rows.groupBy(*keys).agg(F.min_by("_iv", "_order").alias("_near"), F.collect_set(F.lit(None).cast("boolean")).alias("_none")).where(F.size("_none") == 0).drop("_none")
    both = found.unionByName(near, allowMissingColumns=True).groupBy(*keys).agg(*(F.max(c).alias(c) for c in ("_n", "_p30", "_p70", "_p50", "_near")))
    stats = both.withColumn("_iv", F.coalesce("_near", "_p50"))
    level = F.when(F.col("_n") < 5, "UNKNOWN").when(F.col("_iv") >= F.col("_p70"), "HIGH").when(F.col("_iv") <= F.col("_p30"), "LOW").otherwise("NEUTRAL")
    return stats.select(*keys, level.alias("iv_state_level"))


def with_iv_state_level(chain: DataFrame, source: DataFrame | None = None) -> DataFrame:
    return attach(chain, iv_levels(chain if source is None else source), UNDERLYING)


def iv_terms(source: DataFrame) -> DataFrame:
    """snapshot_date, underlying_symbol, iv_state_term: term structure, the median volatility of the second expiration against the first."""
    keys = UNDERLYING
    per = source.where((F.col("implied_volatility") > 0) & F.col("expiration_date").isNotNull())
    per = quantiles(per, [*keys, "expiration_date"], "implied_volatility", {"m": 0.5})
    w = Window.partitionBy(*keys).orderBy("expiration_date")
    first = per.select(*keys, "m", F.lead("m").over(w).alias("next"), F.row_number().over(w).alias("k")).where("k = 1")
    move = F.col("next") / F.col("m")
    state = F.when(F.col("next").isNull(), "UNKNOWN").when(move >= 1.05, "RISING").when(move <= 0.95, "FALLING").otherwise("FLAT")
    return first.select(*keys, state.alias("iv_state_term"))


def with_iv_state_term(chain: DataFrame, source: DataFrame | None = None) -> DataFrame:
    return attach(chain, iv_terms(chain if source is None else source), UNDERLYING).withColumn("iv_state_term", F.coalesce("iv_state_term", F.lit("UNKNOWN")))


def strike_increments(source: DataFrame) -> DataFrame:
    """snapshot_date, underlying_symbol, option_type, listed_strike_increment: least step between listed strikes at the nearest expiration of three different strikes or more, by underlying and type."""
    keys = SIDE
    strikes = source.where((F.col("strike") > 0) & F.col("expiration_date").isNotNull()).select(*keys, "expiration_date", "strike").distinct()
    step = F.col("strike") - F.lag("strike").over(Window.partitionBy(*keys, "expiration_date").orderBy("strike"))
    per = strikes.withColumn("step", step).groupBy(*keys, "expiration_date").agg(F.count("*").alias("n"), F.min("step").alias("step")).where("n >= 3")
    return per.groupBy(*keys).agg(F.min_by("step", "expiration_date").alias("listed_strike_increment"))


def with_strike_increment(chain: DataFrame, source: DataFrame | None = None) -> DataFrame:
    return attach(chain, strike_increments(chain if source is None else source), SIDE)


def theta_quartiles(source: DataFrame, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """snapshot_date, underlying_symbol, option_type, _p25: first quartile of theta efficiency."""
    return quantiles(source, SIDE, "theta_efficiency", {"_p25": 0.25}, store).drop("_n")


def with_theta_below_p25(chain: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Whether theta efficiency is below the first quartile of its underlying and type."""
    stats = theta_quartiles(chain if source is None else source)
    return attach(chain, stats, SIDE).withColumn("theta_efficiency_below_p25", F.col("theta_efficiency") < F.col("_p25")).drop("_p25")


def expected_moves(source: DataFrame) -> DataFrame:
    """snapshot_date, underlying_symbol, expiration_date and MOVES: expected move of each expiration from the mean volatility of the rows closest to the money."""
    keys = EXPIRATION
    valid = source.where((F.col("underlying_price") > 0) & (F.col("time_to_expiration_years") > 0) & (F.col("implied_volatility") > 0) & F.col("strike_distance_pct").isNotNull())
    distance = F.col("strike_distance_pct")
    # one row for each distance first, so that a hot expiration is no large group
    by_distance = valid.groupBy(*keys, "strike_distance_pct").agg(
        F.sum("implied_volatility").alias("iv"), F.count("*").alias("n"), F.max("underlying_price").alias("s"), F.max("time_to_expiration_years").alias("t")
    )
    nearest = by_distance.withColumn("_least", F.min("strike_distance_pct").over(Window.partitionBy(*keys)))
    close = nearest.where(F.abs(distance - F.col("_least")) <= 1e-8 + 1e-5 * F.abs("_least"))
    stats = close.groupBy(*keys).agg((F.sum("iv") / F.sum("n")).alias("iv"), F.max("s").alias("s"), F.max("t").alias("t"))
    move = F.col("s") * F.col("iv") * F.sqrt("t")
    return stats.select(
        *keys, move.alias("expected_move"), (move / F.col("s")).alias("expected_move_pct"), (F.col("s") - move).alias("expected_move_lower_bound"), (F.col("s") + move).alias("expected_move_upper_bound")
    )


def with_expected_move(chain: DataFrame, source: DataFrame | None = None) -> DataFrame:
    return attach(chain, expected_moves(chain if source is None else source), EXPIRATION)


def with_all(chain: DataFrame, source: DataFrame, kept: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Levels, terms and increments of `source`, quartiles (`_p25`, for BELOW_P25) and moves of `kept`, attached with one join for each set of keys.

    All statistics are one table, which `store` writes and reads again: only then does Spark know their size, and sends them to the rows where they are small instead
    of shuffling the rows. They belong on rows that have few columns yet: Spark makes no common method of a join of more than a hundred, and copies the row in each.
    """
    found = [iv_levels(source), iv_terms(source), strike_increments(source), theta_quartiles(kept, store), expected_moves(kept)]
    first, *rest = (x.withColumn("_kind", F.lit(k)) for k, x in enumerate(found))
    for x in rest:
        first = first.unionByName(x, allowMissingColumns=True)
    table = store(first)
    for keys, kinds in ((UNDERLYING, (0, 1)), (SIDE, (2, 3)), (EXPIRATION, (4,))):
        values = [c for k in kinds for c in found[k].columns if c not in keys]
        chain = attach(chain, table.where(F.col("_kind").isin(*kinds)).groupBy(*keys).agg(*(F.max(c).alias(c) for c in values)), keys)
    return chain.withColumn("iv_state_term", F.coalesce("iv_state_term", F.lit("UNKNOWN")))


#: The row column that reads an attached quartile.
BELOW_P25: Definitions = {"theta_efficiency_below_p25": lambda c, p: f"{c.theta_efficiency} < {c._p25}"}


def with_roll_yield(chain: DataFrame) -> DataFrame:
    """Gain per day of rolling from the previous listed expiration of one strike."""
    w = Window.partitionBy(*SNAPSHOT, "underlying_symbol", "option_type", "strike").orderBy("days_to_expiration", "expiration_date", "contract_symbol")
    out = chain.withColumns(
        {
            "roll_from_expiration_date": F.lag("expiration_date").over(w),
            "_days": F.col("days_to_expiration") - F.lag("days_to_expiration").over(w),
            "roll_from_premium_reference_price": F.lag("premium_reference_price").over(w),
        }
    )
    ok = F.col("roll_from_premium_reference_price").isNotNull() & (F.col("_days") > 0)
    out = out.withColumns({"roll_days_added": F.when(ok, F.col("_days")), "roll_net_credit": F.when(ok, F.col("premium_reference_price") - F.col("roll_from_premium_reference_price"))})
    return out.withColumn("roll_yield", F.col("roll_net_credit") / F.col("roll_days_added")).drop("_days")


def historical_volatility(closes: DataFrame, params: Params) -> DataFrame:
    """Annualised deviation of the last `hv_lookback_days` log returns of each symbol; missing with fewer. closes: symbol, date, close."""
    ordered = Window.partitionBy("symbol").orderBy("date", "close")
    returns = closes.where(F.col("close").isNotNull()).withColumn("r", F.ln(F.col("close") / F.lag("close").over(ordered)))
    last = returns.where("r is not null").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"), F.desc("close")))).where(F.col("k") <= params.hv_lookback_days)
    stats = last.groupBy("symbol").agg(F.count("*").alias("n"), F.stddev_samp("r").alias("sd"))
    value = F.when(F.col("n") >= params.hv_lookback_days, F.col("sd") * (float(params.trading_days_per_year) ** 0.5))
    return closes.select("symbol").distinct().join(stats, "symbol", "left").select("symbol", value.alias("historical_volatility"))
