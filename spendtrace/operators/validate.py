"""Column contract, row checks and defaults of incoming transactions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.functions.columns import generated_transaction_id


def check_columns(columns: list[str], required: list[str] | None = None) -> None:
    """Raise for missing required columns, before any job runs."""
    missing = sorted(set(required or C.BATCH_REQUIRED) - set(columns))
    if missing:
        raise ValueError(f"input is missing required columns: {missing}")


def conform(batch: DataFrame) -> DataFrame:
    """All batch columns with their types; absent optional ones become null.

    A value that does not parse becomes null and its column name is listed in
    `_unparsed`.
    """
    check_columns(batch.columns)
    out, broken = [], []
    for f in C.BATCH_SCHEMA.fields:
        if f.name not in batch.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        source = F.col(f.name)
        keeps_type = f.name in ("customer_id", "transaction_id", "timestamp") and (
            dict(batch.dtypes)[f.name] != "string" or f.name != "timestamp")
        value = source if keeps_type else source.try_cast(f.dataType)
        out.append(value.alias(f.name))
        if not keeps_type:
            given = source.isNotNull() & (F.trim(source.cast("string")) != "")
            broken.append(F.when(given & value.isNull(), F.lit(f.name)))
    unparsed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    rest = [c for c in batch.columns if c not in C.BATCH_SCHEMA.fieldNames()]
    return batch.select(*out, *rest, unparsed.alias("_unparsed"))


def _rules() -> dict[str, Column]:
    return {
        "customer_id is missing": F.coalesce(
            F.trim(F.col("customer_id").cast("string")) == "", F.lit(True)),
        "amount is missing": F.col("amount").isNull() | F.isnan("amount"),
        "amount must be positive": F.col("amount") <= 0,
        "merchant_category is missing": F.col("merchant_category").isNull(),
        "failed_logins_24h must not be negative": F.col("failed_logins_24h") < 0,
    }


# The row rules by name.
RULES = ("customer_id is missing", "amount is missing", "amount must be positive",
         "merchant_category is missing", "failed_logins_24h must not be negative")


def violation_list() -> Column:
    """Names of the row rules a conformed row breaks."""
    rules = _rules()
    return F.array_compact(F.array(*[F.when(rules[n], F.lit(n)) for n in RULES]))


def with_violations(batch: DataFrame) -> DataFrame:
    """Conformed rows with `violations`, the rules each row breaks."""
    unparsed = F.transform("_unparsed", lambda c: F.concat(c, F.lit(" does not parse")))
    return (conform(batch)
            .withColumn("violations", F.concat(violation_list(), unparsed))
            .drop("_unparsed"))


@dataclass(frozen=True)
class Checked:
    valid: DataFrame
    quarantined: DataFrame


def check_rows(batch: DataFrame) -> Checked:
    rows = with_violations(batch)
    return Checked(rows.filter(F.size("violations") == 0).drop("violations"),
                   rows.filter(F.size("violations") > 0))


def with_defaults(rows: DataFrame, device_pattern: str = C.DEFAULT_DEVICE_PATTERN,
                  location: str = C.DEFAULT_LOCATION, request: str = "") -> DataFrame:
    """Fill what a caller may leave out.

    A missing device becomes the customer's presumed device, a missing location
    the home city, missing login failures 0 and a missing time now.

    A missing id is made from the row as it was given, its place in the input
    (`file_row`, where the reader adds it) and the name of the `request`; never
    from the time of the run, so a job that runs again gives the same ids.
    Without a place, equal rows of a batch are numbered, so each is a request of
    its own; give `request` to tell equal rows of different requests apart. A
    stream has no places; there the ids are drawn at random.
    """
    before, after = device_pattern.split("{}")
    own_device = F.concat(F.lit(before), F.col("customer_id").cast("string"), F.lit(after))

    def given(column: str) -> Column:
        return F.nullif(F.col(column), F.lit(""))

    as_given = [F.lit(request), *[F.col(c) for c in C.BATCH_SCHEMA.fieldNames()
                                  if c != "transaction_id"]]
    if "file_row" in rows.columns:
        as_given.append(F.to_json(F.struct("file_row")))
    elif rows.isStreaming:
        as_given.append(F.uuid())
    else:
        own = Window.partitionBy(*as_given[1:], F.col("transaction_id").isNull())
        rows = rows.withColumn("_nth", F.row_number().over(own.orderBy(F.lit(0))))
        as_given.append(F.col("_nth"))
    rows = rows.withColumn("transaction_id", F.coalesce(
        F.col("transaction_id"), generated_transaction_id(*as_given)))
    return rows.drop("_nth").withColumns({
        "device_id": F.coalesce(given("device_id"), own_device),
        "location": F.coalesce(given("location"), F.lit(location)),
        "failed_logins_24h": F.coalesce("failed_logins_24h", F.lit(0)),
        "timestamp": F.coalesce("timestamp", F.current_timestamp()),
    })
