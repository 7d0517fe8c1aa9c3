"""Summaries of days that merge: columns of a table, and scores with their labels.

A day is counted once, from its own rows. Any span of days is then summed from
those counts, whose number does not depend on the rows of a day.

Values fall into buckets of fixed relative width, so the counts of a bucket add up
over days. A quantile read from them is off by at most `RELATIVE_ERROR` of its value;
count, mean, standard deviation, least and greatest value are exact. Scores fall
into buckets of their log odds; the area under the curve read from them comes with
the greatest error that the ties inside the buckets allow.

Null values and values that are not finite are left out; a day or column without any
other gives no row. A null day is a day of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATIVE_ERROR = 0.005
LEAST_VALUE = 1e-9  # anything nearer to zero counts as zero
WIDTH = math.log((1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR))
SHIFT = 4000  # makes the number of the least value's bucket positive
BEYOND = 1 << 30  # bucket of the infinite value
ODDS_LIMIT = 20.0
ODDS_STEPS = 200  # buckets of the log odds to one


def value_bucket(value: Column) -> Column:
    """The bucket of a value; buckets are in the order of the values, with NaN last."""
    size = F.abs(value)
    number = F.ceil(F.ln(size) / WIDTH).cast("int") + SHIFT
    return F.when(F.isnan(value), BEYOND + 1).when(size == math.inf, F.signum(value).cast("int") * BEYOND).when(
        size < LEAST_VALUE, 0).when(value < 0, -number).otherwise(number)


def bucket_value(bucket: Column) -> Column:
    """The value of a bucket that is nearest, in proportion, to all of its values."""
    middle = F.exp((F.abs(bucket) - SHIFT) * WIDTH) * (1 - RELATIVE_ERROR)
    return F.when(bucket == 0, 0.0).when(bucket < 0, -middle).otherwise(middle)


def score_bucket(score: Column) -> Column:
    """The bucket of a score from 0 to 1, by its log odds between fixed limits."""
    odds = F.when(score <= 0, -ODDS_LIMIT).when(score >= 1, ODDS_LIMIT).otherwise(
        F.ln(score / (1 - score)))
    return F.floor(F.greatest(F.lit(-ODDS_LIMIT), F.least(F.lit(ODDS_LIMIT), odds)) * ODDS_STEPS).cast("int")


def daily_values(rows: DataFrame, day: Column, columns: list[str]) -> DataFrame:
    """(day, feature, buckets): a row per day and column, buckets as a list in their order.

    A bucket has its number, rows, least and greatest value, mean, and the sum of the
    squared differences from that mean. Rows are combined per bucket before the shuffle.
    """
    finite = rows.select(day.alias("day"), *[F.when(F.abs(v) < math.inf, v).alias(c) for c, v in (
        (c, F.col(c).cast("double")) for c in columns)])
    return _lists(value_buckets(finite, columns, "day"), ["day", "feature"],
                  ["bucket", "n", "low", "high", "middle", "squares"])


def value_buckets(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """(keys, feature, bucket, n, low, high, middle, squares): a row per bucket, nulls left out."""
    long = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("p")).select(*keys, "p.*").filter(F.col("value").isNotNull())
    return long.withColumn("bucket", value_bucket(F.col("value"))).groupBy(*keys, "feature", "bucket").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.avg("value").alias("middle"), (F.var_pop("value") * F.count("*")).alias("squares"))


def daily_scores(rows: DataFrame, day: Column, score: str, label: str) -> DataFrame:
    """(day, buckets): a row per day, buckets of scores with their rows of each label."""
    counts = rows.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(
        day.alias("day"), score_bucket(F.col(score)).alias("bucket")).agg(
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(~F.col(label).eqNullSafe(1)).alias("negatives"))
    return _lists(counts, ["day"], ["bucket", "positives", "negatives"])


def _lists(counts: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    # as many entries as there are buckets, whatever the number of rows
    return counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("buckets"))


def value_summary(daily: DataFrame) -> DataFrame:
    """count, mean, sample std, min, quartiles, max of each column over all days in `daily`.

    Quartiles interpolate between the two rows around them, like the exact ones.
    """
    placed = merged_buckets(daily.select("feature", F.inline("buckets")))
    value = bucket_value(F.col("bucket"))
    shown = F.greatest("low", F.least(F.col("high"), value))
    return moments(placed, *[
        F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), shown)).alias(name)
        for name, rank in quartile_ranks().items()]).select(
        "feature", "count", "mean", "std", "min", *between_ranks(), "max")


def placed_buckets(buckets: DataFrame) -> DataFrame:
    """Buckets, one row each, with the count and mean of their column and the rows below each."""
    column = Window.partitionBy("feature")  # a row per bucket
    off = F.col("middle") - F.col("mean")
    return buckets.withColumns({
        "count": F.sum("n").over(column),
        "mean": F.sum(F.col("n") * F.col("middle")).over(column) / F.sum("n").over(column),
        "below": F.sum("n").over(column.orderBy("bucket")) - F.col("n")}).withColumn(
        "squares", F.col("squares") + F.col("n") * off * off)


def merged_buckets(counts: DataFrame) -> DataFrame:
    """Buckets of many days summed and placed."""
    # one row per column of the table, so the list to broadcast is a short one
    totals = counts.groupBy("feature").agg(
        F.sum("n").alias("count"), (F.sum(F.col("n") * F.col("middle")) / F.sum("n")).alias("mean"))
    off = F.col("middle") - F.col("mean")
    return counts.join(F.broadcast(totals), "feature").groupBy("feature", "count", "mean", "bucket").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum(F.col("squares") + F.col("n") * off * off).alias("squares")).withColumn(
        # a row per bucket
        "below", F.sum("n").over(Window.partitionBy("feature").orderBy("bucket")) - F.col("n"))


def moments(placed: DataFrame, *more: Column) -> DataFrame:
    """(feature, count, mean, std, min, max) from placed buckets, with more aggregates."""
    return placed.groupBy("feature", "count", "mean").agg(
        F.sum("squares").alias("_squares"), F.min("low").alias("min"), F.max("high").alias("max"),
        *more).withColumn("std", F.when(
            F.col("count") > 1, F.sqrt(F.col("_squares") / (F.col("count") - 1)))).drop("_squares")


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def quartile_ranks() -> dict[str, Column]:
    """The places of the rows around each quartile, from 0, by the name of their column."""
    places = {name: (F.col("count") - 1) * share for name, share in QUARTILES.items()}
    return {f"{name}_{end}": f(place) for name, place in places.items()
            for end, f in (("low", F.floor), ("high", F.ceil))}


def between_ranks() -> list[Column]:
    """The quartiles, interpolated from the values of the columns of `quartile_ranks`."""
    found = []
    for name, share in QUARTILES.items():
        place = (F.col("count") - 1) * share
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        found.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return found


def auc_summary(daily: DataFrame, *span: str) -> DataFrame:
    """(span, n, auc_roc, auc_error) over the days of each value of the columns `span`.

    The exact area, ties counting half, lies within auc_error of auc_roc; both are
    null where one of the labels is missing.
    """
    merged = daily.select(*span, F.inline("buckets")).groupBy(*span, "bucket").agg(
        F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"))
    below = F.sum("negatives").over(Window.partitionBy(*span).orderBy("bucket")) - F.col("negatives")
    tied = F.col("positives") * F.col("negatives") / 2
    sums = merged.withColumns({"_pairs": F.col("positives") * below + tied, "_tied": tied}).groupBy(*span).agg(
        F.sum("positives").alias("_p"), F.sum("negatives").alias("_n"),
        F.sum("_pairs").alias("_pairs"), F.sum("_tied").alias("_tied"))
    pairs = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_p").cast("double") * F.col("_n"))
    return sums.select(*span, (F.col("_p") + F.col("_n")).alias("n"),
                       (F.col("_pairs") / pairs).alias("auc_roc"), (F.col("_tied") / pairs).alias("auc_error"))
