"""Order-dependent aggregates that never sort an unbounded group in one task.

Every group is cut into value ranges by Spark's range partitioning, on the order key as it is, whatever its
type. The cut rows are checkpointed, so range numbers and values stay what they were; each range is
handled on its own, and only totals per group and range are combined. A run of equal keys may be
cut over several ranges: its rows learn from the totals how much of the run lies before and behind
their range, so half of all rows may carry one key. There is one path for every size, and nothing is
joined on the order key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import hold, settle

_RANGE, _SPREAD = "__range", "__spread"
BROADCAST_ROWS = 200_000


def attach(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a per-case table onto big rows, broadcasting it only if its counted size allows.

    The keys here are few-valued (often one constant), so shuffling the big side by them
    would pile it onto one task; beyond the bound adaptive skew handling takes over.
    """
    kept = hold(small)
    return df.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, keys, how)


def equi(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns that may be null, keeping one copy of each key."""
    renamed = other
    cond = F.lit(True)
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    for k in keys:
        cond = cond & df[k].eqNullSafe(renamed[f"__r_{k}"])
    return df.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; maps, which have none, are left out."""
    return F.xxhash64(*[F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def placed(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The rows with the number of their value range, settled; numbers rise with (by, order).

    Equal keys are cut further by a hash of the whole row, so only rows equal in every column stay together.
    """
    cut = df.withColumn(_SPREAD, row_hash(df)).repartitionByRange(*by, order, _SPREAD)
    return settle(cut.withColumn(_RANGE, F.spark_partition_id()).drop(_SPREAD))


def totals_before(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per group and range: each sum over the ranges before (out_before) and over the whole group (out_all)."""
    totals = rows.groupBy(*by, _RANGE).agg(*[v.alias(o) for o, v in sums.items()])
    group = Window.partitionBy(*by)
    earlier = group.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    each = [F.coalesce(F.sum(o).over(earlier), F.lit(0)).alias(f"{o}_before") for o in sums]
    return totals.select(*by, _RANGE, *each, *[F.sum(o).over(group).alias(f"{o}_all") for o in sums])


def with_totals(rows: DataFrame, by: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    """Placed rows with, for each value o: o_under (sum over smaller keys), o_upto (over keys up to
    the row's own, all its equals included) and o_all (over the group).

    Of a run cut over ranges, all ranges but its first start with its key and all but its last end with it. Hence
    the sums at both ends of each range, added up over ranges that share the end's key, give what other
    ranges hold of a row's run.
    """
    key = F.struct(order)
    part, level = Window.partitionBy(*by, _RANGE), Window.partitionBy(*by, _RANGE, order)
    zero = F.lit(0)
    rows = rows.withColumns({f"{o}_v": F.coalesce(v, zero) for o, v in values.items()})
    inside = {f"{o}_in": F.sum(f"{o}_v").over(part.orderBy(order)) for o in values}
    rows = rows.withColumns(inside | {f"{o}_at": F.sum(f"{o}_v").over(level) for o in values})
    per = rows.groupBy(*by, _RANGE).agg(
        F.min(key).alias("__lo"),
        F.max(key).alias("__hi"),
        *[F.sum(f"{o}_v").alias(f"{o}_n") for o in values],
        *[F.min_by(f"{o}_at", key).alias(f"{o}_nlo") for o in values],
        *[F.max_by(f"{o}_at", key).alias(f"{o}_nhi") for o in values],
    )
    per = hold(per)
    low = per.select(*by, _RANGE, F.lit(True).alias("__low"), F.col("__lo").alias("__end"), *[F.col(f"{o}_nlo").alias(f"{o}_e") for o in values])
    high = per.where("__hi != __lo").select(*by, _RANGE, F.lit(False).alias("__low"), F.col("__hi").alias("__end"), *[F.col(f"{o}_nhi").alias(f"{o}_e") for o in values])
    run = Window.partitionBy(*by, "__end")
    before = run.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    after = run.orderBy(_RANGE).rowsBetween(1, Window.unboundedFollowing)
    ends = low.unionByName(high)
    ends = ends.withColumns({f"{o}_pre": F.coalesce(F.sum(f"{o}_e").over(before), zero) for o in values} | {f"{o}_post": F.coalesce(F.sum(f"{o}_e").over(after), zero) for o in values})
    wide = ends.groupBy(*by, _RANGE).agg(
        *[F.max(F.when(F.col("__low"), F.col(f"{o}_pre"))).alias(f"{o}_pre") for o in values],
        *[F.max_by(f"{o}_post", "__end").alias(f"{o}_post") for o in values],
    )
    group = Window.partitionBy(*by)
    earlier = group.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{o}_before": F.coalesce(F.sum(f"{o}_n").over(earlier), zero) for o in values}
    sums |= {f"{o}_all": F.sum(f"{o}_n").over(group) for o in values}
    ranges = equi(per.withColumns(sums).select(*by, _RANGE, "__lo", "__hi", *sums), wide, [*by, _RANGE])
    met = equi(rows, ranges, [*by, _RANGE])
    out = {}
    for o in values:
        upto = F.col(f"{o}_before") + F.col(f"{o}_in")
        early = F.when(key == F.col("__lo"), F.col(f"{o}_pre")).otherwise(zero)
        late = F.when(key == F.col("__hi"), F.col(f"{o}_post")).otherwise(zero)
        out |= {f"{o}_under": upto - F.col(f"{o}_at") - early, f"{o}_upto": upto + late}
    return met.withColumns(out)


def running_sum(df: DataFrame, by: list[str], order: str, values: dict[str, str]) -> DataFrame:
    """Inclusive running sums of `values` (output name -> input column) by ascending `order`; equal keys share theirs."""
    out = with_totals(placed(df, by, order), by, order, {f"__{o}": F.col(c) for o, c in values.items()})
    return out.select(*df.columns, *[F.col(f"__{o}_upto").alias(o) for o in values])


def average_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Tie-averaged ascending rank of every row within its group."""
    ranked = with_totals(placed(df, by, value), by, value, {"__n": F.lit(1)})
    return ranked.select(*df.columns, ((F.col("__n_under") + F.col("__n_upto") + 1) / 2.0).alias(out))


def step_up(df: DataFrame, by: list[str], p: str, scale, out: str) -> DataFrame:
    """min over p' >= p of p' * m * scale(m) / rank(p'), clipped to 0..1; m rows a group, ties rank last."""
    rows = with_totals(placed(df, by, p), by, p, {"__m": F.lit(1)})
    part = Window.partitionBy(*by, _RANGE).orderBy(p)
    m = F.col("__m_all")
    curve = rows.withColumn("__raw", F.col(p) * m * scale(m) / F.col("__m_upto"))
    lows = curve.groupBy(*by, _RANGE).agg(F.min("__raw").alias("__low"))
    after = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(1, Window.unboundedFollowing)
    lows = lows.select(*by, _RANGE, F.min("__low").over(after).alias("__later"))
    onward = part.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    least = equi(curve.withColumn("__here", F.min("__raw").over(onward)), lows, [*by, _RANGE])
    q = F.least(F.greatest(F.least("__here", "__later"), F.lit(0.0)), F.lit(1.0))
    return least.select(*df.columns, q.alias(out))


def mann_whitney(hist: DataFrame, by: list[str], order: str) -> DataFrame:
    """u, n1 and n0 per group from (order, n1, n0) rows: n1 times the n0 below, half of those level with it.

    One pass: each range sums its own pairs, and what it needs of other ranges is their n0.
    """
    rows = hist.repartitionByRange(*by, order).withColumn(_RANGE, F.spark_partition_id())
    part = Window.partitionBy(*by, _RANGE).orderBy(order)
    level = Window.partitionBy(*by, _RANGE, order)
    below = F.sum("n0").over(part) - F.sum("n0").over(level) / 2.0
    sums = rows.withColumn("__u", F.col("n1") * below).groupBy(*by, _RANGE)
    sums = sums.agg(F.sum("__u").alias("__u"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    earlier = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("n0").over(earlier), F.lit(0)))
    u = F.sum(F.col("__u") + F.col("n1") * F.col("__before"))
    return sums.groupBy(*by).agg(u.alias("u"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def placed_sums(hist: DataFrame, by: list[str], order: str, n: str, within: list[str]) -> DataFrame:
    """Per by + within: u, n and weighted, from rows (by, within, order, n) that share ranks over all of `by`.

    u sums, over the members, the members of `by` below and half of those level, themselves included;
    weighted sums the order values.
    """
    rows = hist.repartitionByRange(*by, order).withColumn(_RANGE, F.spark_partition_id())
    part = Window.partitionBy(*by, _RANGE).orderBy(order)
    mid = F.sum(n).over(part) - F.sum(n).over(Window.partitionBy(*by, _RANGE, order)) / 2.0
    sums = rows.withColumn("__u", F.col(n) * mid).groupBy(*by, *within, _RANGE)
    sums = hold(sums.agg(F.sum("__u").alias("__u"), F.sum(n).alias("__n"), F.sum(F.col(n) * F.col(order)).alias("__w")))
    base = totals_before(sums, by, {"__t": F.sum("__n")}).select(*by, _RANGE, "__t_before")
    u = F.sum(F.col("__u") + F.col("__n") * F.col("__t_before"))
    out = equi(sums, base, [*by, _RANGE]).groupBy(*by, *within)
    return out.agg(u.alias("u"), F.sum("__n").alias("n"), F.sum("__w").alias("weighted"))


def position_in_group(df: DataFrame, by: list[str], order: str, out: str) -> DataFrame:
    """1-based position by a unique `order` key."""
    return running_sum(df.withColumn("__one", F.lit(1)), by, order, {out: "__one"}).drop("__one")


def row_position(df: DataFrame, order: str, out: str) -> DataFrame:
    """1-based position of every row by ascending `order`; rows of equal keys come one after another, by their hash."""
    rows = placed(df, [], order)
    base = totals_before(rows, [], {"__rows": F.count("*")}).select(_RANGE, "__rows_before")
    inside = F.row_number().over(Window.partitionBy(_RANGE).orderBy(order, row_hash(df)))
    met = rows.withColumn("__inside", inside).join(base, _RANGE)
    return met.select(*df.columns, (F.col("__inside") + F.col("__rows_before")).alias(out))


def top_k(
    df: DataFrame, by: list[str], order: list[Column], k: int, out: str | None = None, salts: int = 64
) -> DataFrame:
    """First k rows of every group by a total order.

    Spark prunes small k before the shuffle by itself; for larger k each group is first
    reduced to k rows inside hashed slices, so a hot group is spread over `salts` tasks.
    """
    rn = out or "__rn"
    src = df
    if k > 1000:
        slice_key = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
        part = Window.partitionBy(*by, "__slice").orderBy(*order)
        src = (
            df.withColumn("__slice", slice_key)
            .withColumn("__srn", F.row_number().over(part))
            .filter(F.col("__srn") <= k)
            .drop("__slice", "__srn")
        )
    ranked = src.withColumn(rn, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rn) <= k)
    return ranked if out else ranked.drop(rn)
