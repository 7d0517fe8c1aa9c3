"""A transaction log as ordered per-customer history.

Nearly all customers fit in one window group. A customer with more rows than
`max_rows` is cut into runs: consecutive stretches of that customer's ordered
history. A window then never sees more than one run, and what happened before
a run is added from small per-run totals ("carry"). Results are the same
either way; only the grouping of the work changes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrace.session import materialize

RUN = "_run"
LEAD = "_lead"
ORDER = ("timestamp", "transaction_id")

# Rows that one window task is meant to hold. Its sorts then take some 0.6 GB,
# however long the log is and however few tasks a session would make of it.
ROWS_PER_TASK = 150_000

# Rows of one customer that one window task may hold: a larger run asked for is
# cut down to this.
MAX_ROWS_PER_RUN = ROWS_PER_TASK

# Most keys a broadcast list of split customers may hold.
MAX_SPLIT_KEYS = 500_000

# Most partitions of one range exchange: its sampler takes at most a million
# rows, and the driver holds all bounds.
MAX_RANGES = 10_000


@dataclass(frozen=True)
class History:
    """`whole`: customers that fit one group. `cut`: the others, by run, or None.

    `cut_tasks` is the number of tasks the cut part is dealt to for its windows,
    0 where Spark may choose, and `is_dealt` whether it has been.
    """

    whole: DataFrame
    cut: DataFrame | None
    key: str
    order: tuple[str, ...]
    cut_order: tuple[str, ...]
    max_rows: int
    cut_tasks: int = 0
    is_dealt: bool = False

    def group(self, *extra: str):
        """Unordered window per customer."""
        return Window.partitionBy(self.key, *extra)

    def run_group(self, *extra: str):
        """Unordered window per customer and run."""
        return Window.partitionBy(self.key, RUN, *extra)

    def ordered(self, *extra: str):
        return self.group(*extra).orderBy(*self.order)

    def run_ordered(self, *extra: str):
        return self.run_group(*extra).orderBy(*self.cut_order)

    def rows(self) -> DataFrame:
        if self.cut is None:
            return self.whole
        return self.whole.unionByName(self.cut.drop(RUN))

    def derive(self, whole: DataFrame, cut: DataFrame | None) -> History:
        return replace(self, whole=whole, cut=cut)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> History:
        """The same change of the rows of both parts."""
        return self.derive(change(self.whole), None if self.cut is None else change(self.cut))

    def settled(self) -> History:
        """Write the cut part once, before it is read for totals and for rows."""
        return self if self.cut is None else replace(
            self, cut=materialize(self.cut, "runs"), is_dealt=False)

    def dealt(self) -> History:
        """The cut part with its runs in tasks of bounded size, for windows over it."""
        if self.cut is None or not self.cut_tasks or self.is_dealt:
            return self
        return replace(self, cut=self.cut.repartition(self.cut_tasks, RUN), is_dealt=True)

    def carried(self, aggregates: dict[str, Column], running: dict[str, Column],
                by: tuple[str, ...] = ()) -> DataFrame:
        """Totals of all runs before each run.

        `aggregates` are taken per (customer, run, by); `running` are
        aggregates of those over the runs before the current one of the same
        (customer, by). The window holds one row per run.
        """
        per_run = self.cut.groupBy(self.key, RUN, *by).agg(
            *[a.alias(name) for name, a in aggregates.items()])
        before = (Window.partitionBy(self.key, *by).orderBy(RUN)
                  .rowsBetween(Window.unboundedPreceding, -1))
        return per_run.select(
            self.key, RUN, *by, *[e.over(before).alias(name) for name, e in running.items()])

    def carried_moments(self, columns: list[str]) -> DataFrame:
        """Count, mean and squared deviations of each column over the runs before.

        Gives x_n0, x_mean0 and x_m20 for a column x.
        """
        per_run = self.cut.groupBy(self.key, RUN).agg(
            *[a for c in columns for a in run_moments(c, F.col(c))])
        return moments_before(per_run, columns, [self.key]).select(
            self.key, RUN, *[f"{c}_{x}" for c in columns for x in ("n0", "mean0", "m20")])

    def with_lead_rows(self, values: list[str], sums: list[str], moments: list[str],
                       row: Column) -> History:
        """The cut part with rows in front of each run that tell what came before it.

        One row per run and one per run and value of each column in `values`;
        `row` marks the rows that count. The lead rows have LEAD 0 and come
        first in `cut_order`. `_w` is 1 on a row that counts and the number of
        earlier ones on a run's lead row; `_w_x` likewise for the value of x.
        `sums` hold the running sums on the run's lead row, and x_n0, x_mean0
        and x_m20 the moments of earlier rows. Running sums over a run so start
        where the run before ended, and windows need no join. All of it comes
        from one pass over the written runs.
        """
        whole_run = len(values)
        types = dict(self.cut.dtypes)
        kinds = [F.struct(F.lit(i).alias("_of"), *[
            (F.col(v) if i == j else F.lit(None).cast(types[v])).alias(f"_v{j}")
            for j, v in enumerate(values)]) for i in range(whole_run + 1)]
        stacked = self.cut.select(
            self.key, RUN, row.alias("_row"), *sums, *moments,
            F.explode(F.when(row, F.array(*kinds)).otherwise(F.array(kinds[-1]))).alias("_kinds")
        ).select("*", "_kinds.*").drop("_kinds")
        slots = [f"_v{j}" for j in range(whole_run)]
        total = F.col("_of") == whole_run
        per_run = stacked.groupBy(self.key, RUN, "_of", *slots).agg(
            F.count_if("_row").alias("_n"),
            *[F.sum(F.when(total, F.col(c))).alias(c) for c in sums],
            *[a for c in moments for a in run_moments(c, F.when(total, F.col(c)))])
        by = [self.key, "_of", *slots]
        before = Window.partitionBy(*by).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
        carried = [f"{c}_{x}" for c in moments for x in ("n0", "mean0", "m20")]
        lead = moments_before(per_run, moments, by).select(
            self.key, RUN, "_of", F.lit(0).alias(LEAD),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums], *carried,
            *[F.col(f"_v{j}").alias(v) for j, v in enumerate(values)])
        lead = lead.filter(total | (F.col("_n") > 0))

        def weight(of: int) -> Column:
            return F.when(F.col("_of") == of, F.col("_n")).otherwise(0)

        lead = lead.withColumns({"_w": weight(whole_run)} | {
            f"_w_{v}": weight(j) for j, v in enumerate(values)}).drop("_of", "_n")
        counts = F.when(row, 1).otherwise(0).cast("bigint")
        rows = self.cut.withColumns({LEAD: F.lit(1), "_w": counts} | {
            f"_w_{v}": counts for v in values})
        return replace(self, cut=rows.unionByName(lead, allowMissingColumns=True),
                       cut_order=(LEAD, *self.cut_order), is_dealt=False).dealt()


def run_moments(name: str, value: Column) -> list[Column]:
    """Count, mean and squared deviations as aggregates."""
    return [F.count(value).alias(f"{name}_n"), F.avg(value).alias(f"{name}_mean"),
            (F.var_pop(value) * F.count(value)).alias(f"{name}_m2")]


def moments_before(per_run: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Adds x_n0, x_mean0 and x_m20, merged over the earlier runs of the same `by`.

    Deviations of the run means are taken from the first run's mean, so no
    large sums cancel.
    """
    runs = Window.partitionBy(*by).orderBy(RUN)
    first = per_run.select("*", *[
        F.first(f"{c}_mean", ignorenulls=True)
        .over(runs.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{c}_pivot")
        for c in columns])
    before = runs.rowsBetween(Window.unboundedPreceding, -1)
    sums = {}
    for c in columns:
        off = F.col(f"{c}_mean") - F.col(f"{c}_pivot")
        sums[f"{c}_n0"] = F.sum(f"{c}_n").over(before)
        sums[f"{c}_off"] = F.sum(F.col(f"{c}_n") * off).over(before)
        sums[f"{c}_off2"] = F.sum(F.col(f"{c}_n") * off * off).over(before)
        sums[f"{c}_m2s"] = F.sum(f"{c}_m2").over(before)
    merged = {}
    for c in columns:
        n, off, off2 = (F.col(f"{c}_{x}") for x in ("n0", "off", "off2"))
        merged[f"{c}_mean0"] = F.when(n > 0, F.col(f"{c}_pivot") + off / n)
        merged[f"{c}_m20"] = F.when(n > 0, F.col(f"{c}_m2s") + F.greatest(
            off2 - off * off / n, F.lit(0.0)))
    return first.withColumns(sums).withColumns(merged) if columns else first


@dataclass(frozen=True)
class LargeKeys:
    """Keys with more than `max_rows` rows, or None. `rows` counts those of all keys.

    A list of up to `MAX_SPLIT_KEYS` is broadcast; a longer one is joined with a
    shuffle, whose large partitions adaptive execution splits.
    """

    keys: DataFrame | None
    total: int
    max_rows: int
    count: int = 0
    rows: int = 0

    def only(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.join(self._list(key), F.col(key).eqNullSafe(F.col("_large")), "left_semi")

    def without(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.join(self._list(key), F.col(key).eqNullSafe(F.col("_large")), "left_anti")

    def _list(self, key: str) -> DataFrame:
        listed = self.keys.select(F.col(key).alias("_large"))
        return F.broadcast(listed) if self.count <= MAX_SPLIT_KEYS else listed


def find_large(rows: DataFrame, key: str, max_rows: int | None = None) -> LargeKeys:
    """Count rows per key, combined before the shuffle, over the key column alone."""
    limit = min(max_rows or MAX_ROWS_PER_RUN, MAX_ROWS_PER_RUN)
    sizes = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    above = F.col("_rows") > limit
    check = sizes.agg(
        F.count_if(above).alias("keys"),
        F.coalesce(F.sum(F.when(above, F.col("_rows"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("all")).first()
    if not check["keys"]:
        return LargeKeys(None, 0, limit, rows=check["all"])
    keys = materialize(sizes.filter(above).select(key), "large-keys")
    return LargeKeys(keys, check["rows"], limit, check["keys"], check["all"])


def by_key(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """Rows of a key in one task, and about `ROWS_PER_TASK` of the `count` rows in each.

    Left alone, Spark joins the parts of a shuffle until there are hardly more
    than it has cores, so that what a task holds grows with the table. One task's
    rows are left alone.
    """
    return rows if count <= ROWS_PER_TASK else rows.repartition(_tasks(rows, count), *keys)


def _tasks(rows: DataFrame, count: int) -> int:
    """Tasks of about `ROWS_PER_TASK` rows, and no fewer than there are cores."""
    return max(math.ceil(count / ROWS_PER_TASK), rows.sparkSession.sparkContext.defaultParallelism)


def semi_join(rows: DataFrame, wanted: DataFrame, key: str, large: LargeKeys) -> DataFrame:
    """Rows whose key is in `wanted`; rows of large keys are never shuffled for it."""
    if large.keys is None:
        return rows.join(wanted, key, "left_semi")
    asked = replace(large, keys=large.keys.join(wanted, key, "left_semi"))
    return large.without(rows, key).join(wanted, key, "left_semi").unionByName(
        asked.only(rows, key))


def split_history(log: DataFrame, key: str = "customer_id",
                  order: tuple[str, ...] = ORDER, max_rows: int | None = None,
                  expand: Callable[[DataFrame], DataFrame] | None = None,
                  cut_order: tuple[str, ...] | None = None,
                  large: LargeKeys | None = None) -> History:
    """Check group sizes and cut the customers that are too large for one group.

    `large` gives the outcome of the check where the caller has it, from the log
    or from a table with at least its rows. `expand` may add rows (for example
    expiry marks) to the customers that are cut; `cut_order` then orders those
    rows as well.

    The order has to be total within a customer, else rows that compare equal
    may swap places.
    """
    cut_order = cut_order or order
    large = large or find_large(log, key, max_rows)
    if large.keys is None:
        return History(by_key(log, large.rows, key), None, key, order, cut_order, large.max_rows)
    cut, rows = large.only(log, key), large.total
    if expand is not None:
        cut, rows = expand(cut), 2 * rows
    # The range partitioner spreads the ordered rows evenly, so a partition is
    # a run, or several where there would be too many partitions. Written out
    # once: every later read must see the same cuts.
    runs = math.ceil(rows / large.max_rows) + 1
    cut = cut.repartitionByRange(min(runs, MAX_RANGES), key, *cut_order)
    run = F.spark_partition_id().cast("bigint")
    if runs > MAX_RANGES:
        cut = cut.sortWithinPartitions(key, *cut_order)
        place = F.monotonically_increasing_id() % (1 << 33)
        run = run * (1 << 32) + F.floor(place / large.max_rows).cast("bigint")
    cut = materialize(cut.withColumn(RUN, run), "runs")
    # runs meet in a task by their hash: twice as many tasks keep that to a few
    tasks = 2 * _tasks(cut, rows) if rows > ROWS_PER_TASK else 0
    whole = by_key(large.without(log, key), large.rows - large.total, key)
    return History(whole, cut, key, order, cut_order, large.max_rows, tasks)


def positions(history: History, name: str = "n_prior") -> History:
    """Number of earlier rows of the same customer."""
    whole = history.whole.withColumn(
        name, F.row_number().over(history.ordered()).cast("bigint") - 1)
    cut = history.dealt().cut
    if cut is not None:
        before = history.carried({"_rows": F.count("*")}, {"_before": F.sum("_rows")})
        cut = (
            cut.withColumn(name, F.row_number().over(history.run_ordered()).cast("bigint") - 1)
            .transform(join_carry, before, history.key)
            .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
            .drop("_before")
        )
    return history.dealt().derive(whole, cut)


def running_total(history: History, column: str, name: str) -> History:
    """Sum of `column` over the earlier rows of the same key, 0 on the first."""
    frame = (Window.unboundedPreceding, -1)

    def total(window) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(*frame)), F.lit(0))

    whole = history.whole.withColumn(name, total(history.ordered()))
    cut = history.dealt().cut
    if cut is not None:
        before = history.carried({"_sum": F.sum(column)}, {"_before": F.sum("_sum")})
        cut = (
            cut.withColumn(name, total(history.run_ordered()))
            .transform(join_carry, before, history.key)
            .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
            .drop("_before")
        )
    return history.dealt().derive(whole, cut)


def first_seen(history: History, column: str, name: str) -> History:
    """1 on the first row of a customer with this value of `column`, else 0."""
    whole = history.whole.withColumn(
        name, F.when(F.row_number().over(history.ordered(column)) == 1, 1).otherwise(0))
    cut = history.dealt().cut
    if cut is not None:
        before = history.carried(
            {"_rows": F.count("*")}, {"_before": F.sum("_rows")}, by=(column,))
        cut = join_carry(
            cut.withColumn("_nth", F.row_number().over(history.run_ordered(column))),
            before, history.key, (column,),
        ).withColumn(
            name, F.when((F.col("_nth") == 1) & F.col("_before").isNull(), 1).otherwise(0),
        ).drop("_nth", "_before")
    return history.dealt().derive(whole, cut)


def seen_count(history: History, column: str, name: str) -> History:
    """Number of earlier rows of the customer with the same value of `column`."""
    whole = history.whole.withColumn(
        name, F.row_number().over(history.ordered(column)).cast("bigint") - 1)
    cut = history.dealt().cut
    if cut is not None:
        before = history.carried(
            {"_rows": F.count("*")}, {"_before": F.sum("_rows")}, by=(column,))
        cut = join_carry(
            cut.withColumn(
                name, F.row_number().over(history.run_ordered(column)).cast("bigint") - 1),
            before, history.key, (column,),
        ).withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")
    return history.dealt().derive(whole, cut)


def merge_moments(n_a: Column, mean_a: Column, m2_a: Column,
                  n_b: Column, mean_b: Column, m2_b: Column) -> tuple[Column, Column, Column]:
    """Count, mean and squared deviations of two disjoint groups; either may be empty."""
    n_a, n_b = F.coalesce(n_a, F.lit(0)), F.coalesce(n_b, F.lit(0))
    count = n_a + n_b
    left, right = F.coalesce(mean_a, mean_b), F.coalesce(mean_b, mean_a)
    gap = right - left
    mean = F.when(count > 0, left + gap * n_b / count)
    m2 = (F.coalesce(m2_a, F.lit(0.0)) + F.coalesce(m2_b, F.lit(0.0))
          + gap * gap * n_a * n_b / count)
    return F.when(count > 0, count), mean, F.when(count > 0, m2)


def join_carry(rows: DataFrame, carry: DataFrame, key: str,
               by: tuple[str, ...] = ()) -> DataFrame:
    """Attach carry rows; a null key or `by` value is a value like any other."""
    names = (key, RUN, *by)
    renamed = carry.select(
        *[F.col(n).alias(f"_c{i}") for i, n in enumerate(names)],
        *[c for c in carry.columns if c not in names])
    same = F.col(key).eqNullSafe(F.col("_c0")) & (F.col(RUN) == F.col("_c1"))
    for i, n in enumerate(by, start=2):
        same = same & F.col(n).eqNullSafe(F.col(f"_c{i}"))
    return rows.join(renamed, same, "left").drop(*[f"_c{i}" for i in range(len(names))])
