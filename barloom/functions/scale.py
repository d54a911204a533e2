"""Group operations that never put one whole key into one task.

A key may hold a third of all rows. Ranks are therefore taken on a histogram of score values, top-k is
taken per salt before it is taken per key, and running totals are taken per (key, time chunk) first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.session import materialise

SALTS = 32


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning at full width: the passes are heavy per row, so partitions must not be merged by size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row frame as scalar subqueries; no join."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def score_histogram(df: DataFrame, by: list[str], score: str, eligible: Column | None = None) -> DataFrame:
    """One row per (by, score): ties, min-rank, and running eligible counts from the best score down.

    The group-by combines map-side, so only distinct score values reach the window.
    """
    elig = F.lit(True) if eligible is None else eligible
    hist = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("ties"),
                                      F.count_if(elig).alias("n_elig"))
    down = W.partitionBy(*by).orderBy(F.col(score).desc_nulls_last())
    run = down.rowsBetween(W.unboundedPreceding, W.currentRow)
    all_ = W.partitionBy(*by)
    return (hist
            .withColumn("min_rank", F.when(F.col(score).isNotNull(),
                                           F.sum("ties").over(run) - F.col("ties") + 1).cast("int"))
            .withColumn("cum_elig", F.sum("n_elig").over(run))
            .withColumn("total_elig", F.sum("n_elig").over(all_))
            .withColumn("n_scored", F.sum(F.when(F.col(score).isNotNull(), F.col("ties"))).over(all_)))


def attach(df: DataFrame, side: DataFrame, keys: list[str], cols: list[str],
           nullable: list[str] = (), how: str = "left") -> DataFrame:
    """Equi join that brings only `cols` of `side`; keys may be NULL-safe."""
    s = side.select(*[F.col(k).alias(f"__{k}") for k in keys], *cols)
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}")) if k in nullable else F.col(k) == F.col(f"__{k}")
        cond = c if cond is None else cond & c
    return df.join(s, cond, how).drop(*[f"__{k}" for k in keys])


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, salt_on: list[str],
          rank_col: str = "rn", salts: int = SALTS) -> DataFrame:
    """Exact k first rows per key in two steps; no task sees more than k x salts rows of a key in step two."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    first = W.partitionBy(*by, "__salt").orderBy(*order)
    part = salted.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= k).drop("__r", "__salt")
    if by:
        last = W.partitionBy(*by).orderBy(*order)
    else:
        last = W.partitionBy(F.lit(0)).orderBy(*order)
    return part.withColumn(rank_col, F.row_number().over(last)).filter(F.col(rank_col) <= k)


def newest_row(df: DataFrame, keys: list[str], order: list[Column], newest: bool = True) -> DataFrame:
    """One whole row per key by a composite order: an aggregate with map-side combine, not a window."""
    rest = [c for c in df.columns if c not in keys]
    agg = F.max_by if newest else F.min_by
    z = df.groupBy(*keys).agg(agg(F.struct(*rest), F.struct(*order)).alias("__row"))
    return z.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def chosen_rows(df: DataFrame, light: list[str], choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Whole rows picked by a rule over few columns. `choose` gets these columns and `_row`, and returns the rows it keeps; wide columns are stored once and
    meet the choice in one semi-join, instead of passing through the rule's aggregations."""
    numbered = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "chosen-from")
    return numbered.join(choose(numbered.select(*light, "_row")).select("_row"), "_row", "left_semi").drop("_row")


def running_sums(df: DataFrame, keys: list[str], chunk: str, order: list[str],
                 sums: dict[str, Column], peers: bool = False) -> DataFrame:
    """Exact running totals over (keys ordered by chunk, order), split by chunk. With `peers`, rows of equal order count at once.

    1. totals per (keys, chunk), combined map-side; 2. running totals of those few rows;
    3. running totals inside each chunk, plus the total of all earlier chunks.
    `chunk` must be a prefix of the order (a date), so the largest task is one key on one date.
    """
    z = df
    for name, expr in sums.items():
        z = z.withColumn(f"__v_{name}", expr)
    part = z.groupBy(*keys, chunk).agg(*[F.sum(f"__v_{n}").alias(f"__p_{n}") for n in sums])
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    part = part.select(*keys, chunk, *[F.coalesce(F.sum(f"__p_{n}").over(before), F.lit(0)).alias(f"__o_{n}")
                                       for n in sums])
    inside = W.partitionBy(*keys, chunk).orderBy(*order)
    inside = inside.rangeBetween(W.unboundedPreceding, W.currentRow) if peers else inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    z = spread(z, *keys, chunk).join(part, [*keys, chunk])
    for n in sums:
        z = z.withColumn(n, F.col(f"__o_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)))
    return z.drop(*[f"__v_{n}" for n in sums], *[f"__o_{n}" for n in sums])


def _within(counted: DataFrame, state: DataFrame, keys: list[str], columns: list[str], salts: int = 64) -> DataFrame:
    """Values inside their key's bracket, with columns of the state. The state is salted, so that a key with most rows meets it in many places."""
    s = state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    z = attach(counted.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salts)).cast("int")), s, [*keys, "_salt"], list({"_lo", "_hi", *columns}), nullable=keys, how="inner")
    return z.filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).drop("_salt")


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median", buckets: int = 64, small: int = 100_000) -> DataFrame:
    """Exact median per key without bringing a key's values together, whatever their distribution.

    Equal values are counted first, where they lie. A bracket per key is then narrowed in rounds: a mergeable sketch of the distinct values
    inside it gives `buckets` - 1 pivots, exact counts tell between which of them the two middle ranks lie. Each round leaves about two of `buckets`
    shares of the distinct values, however many rows share a value, until no bracket holds more than `small`; those are ranked. The driver sees
    one number per round.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    counted = materialise(counted, "median-values")
    state = counted.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_k").alias("_n"), F.count(F.lit(1)).alias("_m"))
    state = materialise(state.withColumn("_below", F.lit(0).cast("long")), "median-state")
    first, second = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    while (state.agg(F.max("_m")).first()[0] or 0) > small:
        counted = materialise(_within(counted, state, keys, []).select(*keys, "_v", "_k"), "median-values")
        steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        pivots = counted.groupBy(*keys).agg(F.percentile_approx("_v", steps, 10000).alias("_pivots"))
        state = attach(state, pivots, keys, ["_pivots"], nullable=keys, how="inner")
        z = _within(counted, state, keys, ["_pivots"])
        z = z.withColumn("_part", F.size(F.filter("_pivots", lambda p: p < F.col("_v"))))
        parts = z.groupBy(*keys, "_part").agg(F.sum("_k").alias("_w"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        parts = attach(parts, state, keys, ["_n", "_below"], nullable=keys, how="inner")
        upto = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
        parts = parts.withColumn("_upto", F.col("_below") + F.sum("_w").over(upto))
        past = F.col("_upto") - F.col("_w")
        parts = parts.filter(((past < first) & (first <= F.col("_upto"))) | ((past < second) & (second <= F.col("_upto"))))
        state = materialise(parts.groupBy(*keys, "_n").agg(F.min("_least").alias("_lo"), F.max("_most").alias("_hi"), F.sum("_d").alias("_m"),
                                                           F.min(past).alias("_below")), "median-state")
    z = _within(counted, state, keys, ["_n", "_below"])
    upto = W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    z = z.withColumn("_upto", F.col("_below") + F.sum("_k").over(upto))
    past = F.col("_upto") - F.col("_k")
    pick = lambda rank: F.max(F.when((past < rank) & (rank <= F.col("_upto")), F.col("_v")))
    z = z.groupBy(*keys).agg(pick(first).alias("_first"), pick(second).alias("_second"))
    return z.select(*keys, ((F.col("_first") + F.col("_second")) / 2).alias(out))


def last_at_or_before(facts: DataFrame, probes: DataFrame, key: str, fact_date: str, probe_date: str,
                      values: list[str], forward: bool = False) -> DataFrame:
    """As-of lookup of `values` for distinct (key, probe_date) pairs.

    Probes are made distinct first, so one key holds at most two rows per calendar date however many rows ask.
    Facts must be unique per (key, date).
    """
    p = probes.select(key, F.col(probe_date).alias("_d")).distinct().withColumn("_probe", F.lit(1))
    f = facts.select(key, F.col(fact_date).alias("_d"), F.struct(*values).alias("_val")).withColumn("_probe", F.lit(0))
    u = f.unionByName(p, allowMissingColumns=True)
    # Facts come before probes of the same date in either direction, so equal dates match.
    d = F.col("_d").desc() if forward else F.col("_d").asc()
    w = W.partitionBy(key).orderBy(d, F.col("_probe").asc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    u = u.withColumn("_hit", F.last("_val", ignorenulls=True).over(w)).filter("_probe = 1")
    return u.select(key, F.col("_d").alias(probe_date), *[F.col(f"_hit.{x}").alias(x) for x in values])
