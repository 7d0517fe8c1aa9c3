"""Windows of the ten latest feature vectors of a customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.operators.history import RUN, History, join_carry
from spendtrace.operators.profile import GROUP_LIMIT


def vector(columns: list[str] | None = None) -> Column:
    """The features of a row as one array, in model order."""
    return F.array(*[F.col(c).cast("double") for c in columns or C.FEATURES])


def last_steps(steps: Column, length: int) -> Column:
    return F.slice(steps, F.greatest(F.size(steps) - length + 1, F.lit(1)), length)


def padded(steps: Column, length: int = C.SEQUENCE_LENGTH) -> Column:
    """Fill a short history in front with its earliest vector; none gives all zeros."""
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), len(C.FEATURES)), length)
    fill = F.array_repeat(F.get(steps, F.lit(0)), F.lit(length) - F.size(steps))
    return F.when(F.size(steps) == 0, zeros).otherwise(F.concat(fill, steps))


def add_steps(history: History, length: int = C.SEQUENCE_LENGTH) -> History:
    """`steps`: vectors of the up to `length` rows before the current one, oldest first."""
    frame = (-length, -1)
    whole = history.whole.withColumn(
        "steps", F.collect_list(vector()).over(history.ordered().rowsBetween(*frame)))
    written, history = history.cut, history.dealt()
    cut = history.cut
    if cut is not None:
        # The last rows of each run; runs may be short, so as many runs back as
        # there are steps always hold enough rows.
        newest = history.run_group().orderBy(*[F.col(c).desc() for c in history.cut_order])
        tails = (
            written.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= length)
            .groupBy(history.key, RUN)
            .agg(F.array_sort(F.collect_list(
                F.struct((-F.col("_back")).alias("at"), vector().alias("vec")))).alias("_tail"))
            .withColumn("_tail", F.col("_tail.vec"))
        )
        runs_back = Window.partitionBy(history.key).orderBy(RUN).rowsBetween(-length, -1)
        before = tails.select(history.key, RUN, last_steps(
            F.flatten(F.collect_list("_tail").over(runs_back)), length).alias("_earlier"))
        cut = (
            cut.withColumn("steps", F.collect_list(vector())
                           .over(history.run_ordered().rowsBetween(*frame)))
            .transform(join_carry, before, history.key)
            .withColumn("steps", last_steps(F.concat(
                F.coalesce("_earlier", F.array().cast("array<array<double>>")), "steps"), length))
            .drop("_earlier")
        )
    return history.derive(whole, cut)


def sequences(history: History, length: int = C.SEQUENCE_LENGTH) -> DataFrame:
    """One training window per row with a full history; the label is the row's own."""
    rows = add_steps(history.settled(), length).rows()
    return rows.filter(F.size("steps") == length).select(
        "customer_id", "transaction_id", F.col("steps").alias("seq"),
        F.col("is_fraud").alias("label"))


def long_form(sequences: DataFrame, column: str = "seq") -> DataFrame:
    """One row per window step, with the features as columns."""
    keys = [c for c in sequences.columns if c != column]
    return sequences.select(*keys, F.posexplode(column).alias("step", "_vec")).select(
        *keys, "step", *[F.get("_vec", F.lit(i)).alias(f) for i, f in enumerate(C.FEATURES)])


def latest_sequence(features: DataFrame, length: int = C.SEQUENCE_LENGTH,
                    order: tuple[str, ...] = ("timestamp", "transaction_id")) -> DataFrame:
    """The latest window per customer, newest row included, padded in front.

    The row-number filter limits rows per customer before the shuffle, so a
    customer of any size sends a few rows per task. That holds up to
    `GROUP_LIMIT` steps; longer windows are refused.
    """
    if length > GROUP_LIMIT:
        raise ValueError(f"a window of the latest rows has at most {GROUP_LIMIT} steps")
    newest = Window.partitionBy("customer_id").orderBy(*[F.col(c).desc() for c in order])
    latest = (
        features.withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= length)
        .groupBy("customer_id")
        .agg(F.array_sort(F.collect_list(
            F.struct((-F.col("_back")).alias("at"), vector().alias("vec")))).alias("_rows"))
    )
    return latest.select("customer_id", padded(F.col("_rows.vec"), length).alias("seq"))
