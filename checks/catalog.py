"""Named queries over the given tables, one per operator or report."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.functions.columns import (
    alert_level, gauge_band, generated_transaction_id, sequential_transaction_id,
)
from spendtrace.operators import boosted as BT
from spendtrace.operators import evaluate as E
from spendtrace.operators import daily as D
from spendtrace.operators import explain as X
from spendtrace.operators import features as FT
from spendtrace.operators import history as H
from spendtrace.operators import learn as L
from spendtrace.operators import profile as P
from spendtrace.operators import rings as R
from spendtrace.operators import sequences as S
from spendtrace.operators import snapshot as SN
from spendtrace.operators import trajectory as TJ
from spendtrace.operators import trees as TR
from spendtrace.operators import validate as V
from spendtrace.plans import reports, scoring
from spendtrace.plans.training import Trained, train
from spendtrace.session import apply_settings, materialize, new_folder
from checks import fixtures as fx
from spendtrace.sources import readers, writers
from spendtrace.sources.readers import scored_as_json, transactions_json
from checks import replay

BATCH_CUT = "2024-01-25 00:00:00"
DAILY_HALF = "2024-01-15"
TIMELINE_CUSTOMER = 8

Query = Callable[[SparkSession, str], DataFrame]


# --- tables several queries start from ------------------------------------------
# Written once per session and folder, like the feature table of the training
# chain, and read with only the columns a query needs.

@dataclass
class _Kept:
    session: str
    tables: dict


_kept = _Kept("", {})


def _keep(spark: SparkSession, folder: str, name: str, build: Callable):
    session = spark.sparkContext.applicationId
    if _kept.session != session:
        _kept.session, _kept.tables = session, {}
    key = (folder, name)
    if key not in _kept.tables:
        _kept.tables[key] = build()
    return _kept.tables[key]


def forget_tables() -> None:
    """Make the next query build its inputs again."""
    _kept.tables.clear()


def _episodes(spark: SparkSession, folder: str) -> tuple[DataFrame, H.LargeKeys]:
    """The episode log and the one check of its customers' sizes."""
    log = fx.episode_log(spark, folder)
    return log, _keep(spark, folder, "episode sizes", lambda: H.find_large(log, "customer_id"))


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """Episode log with features, n_prior and the fixed stage-1 risk score."""
    def build():
        log, large = _episodes(spark, folder)
        return materialize(scoring.with_risk(
            log, L.fixed_trajectory_model(), fx.episode_home(), large=large), "features")
    return _keep(spark, folder, "features", build)


def _scored(spark: SparkSession, folder: str, with_reasons: bool) -> DataFrame:
    """The episode log scored with the fixed models, from its feature table."""
    models, large = fixed_models(spark, folder), _episodes(spark, folder)[1]
    return scoring.score_features(
        feature_table(spark, folder), models, large, with_reasons=with_reasons)


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    return L.add_split(scoring.hand_off(feature_table(spark, folder)))


def fixed_models(spark: SparkSession, folder: str) -> L.RiskModels:
    """Fixed coefficients with the scaler and background of the training rows."""
    def build():
        rows = training_rows(spark, folder).filter("not is_test")
        scaler = L.read_scaler(L.scaler_stats(rows, C.MODEL_INPUTS), C.MODEL_INPUTS)
        return L.RiskModels(
            L.fixed_trajectory_model(), L.fixed_transaction_model(scaler),
            L.read_background(L.background_sample(rows, scaler)))
    return _keep(spark, folder, "fixed models", build)


def scored_table(spark: SparkSession, folder: str) -> DataFrame:
    """The whole episode log scored with the fixed models, with reasons."""
    return _keep(spark, folder, "scored", lambda: materialize(
        _scored(spark, folder, True), "scored"))


def trained(spark: SparkSession, folder: str) -> Trained:
    return _keep(spark, folder, "trained", lambda: train(
        fx.episode_log(spark, folder), fx.episode_home()))


def _test_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out rows with the evaluated probability: limited inputs, no cap."""
    model = fixed_models(spark, folder).transaction
    return training_rows(spark, folder).filter("is_test").withColumn(
        "probability", model.probability(L.normalised_inputs(model.scaler)))


def _served(spark: SparkSession, folder: str) -> DataFrame:
    return feature_table(spark, folder).withColumn(
        "_p", fixed_models(spark, folder).transaction.served_probability())


def _rounded(rows: DataFrame, columns, digits: int = 6) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c in columns})


# --- queries ----------------------------------------------------------------------

def txn_canonical(spark, folder):
    text = F.col("timestamp").cast("string")
    return fx.episode_log(spark, folder).select(
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.to_timestamp_ntz(text).alias("timestamp"), "amount", "merchant_category",
        "device_id", "location", "failed_logins_24h", "is_fraud")


def contract_violations(spark, folder):
    return V.with_violations(fx.dirty_batch(spark, folder)).filter(F.size("violations") > 0).select(
        "transaction_id", F.array_join("violations", "; ").alias("violations"))


def violation_counts(spark, folder):
    return (V.check_rows(fx.dirty_batch(spark, folder)).quarantined
            .select(F.explode("violations").alias("violation"))
            .groupBy("violation").agg(F.count("*").alias("n")))


def batch_defaults(spark, folder):
    valid = V.check_rows(fx.dirty_batch(spark, folder)).valid
    return V.with_defaults(valid).select(
        "customer_id", "transaction_id", "timestamp", "amount", "merchant_category",
        "device_id", "location", "failed_logins_24h")


def generated_ids(spark, folder):
    key = [F.col(c) for c in ("customer_id", "transaction_id", "merchant_category")]
    return fx.episode_log(spark, folder).select(
        "transaction_id", generated_transaction_id(*key).alias("generated_id"))


def sequential_ids(spark, folder):
    log = fx.hot_log(spark, folder).select("customer_id", "timestamp", "transaction_id")
    numbered = H.positions(H.split_history(
        log.withColumn("_all", F.lit(0)), key="_all",
        order=("customer_id", "timestamp", "transaction_id")), "_nth")
    return numbered.rows().select(
        "transaction_id", sequential_transaction_id(F.col("_nth")).alias("sequential_id"))


def new_device_flags(spark, folder):
    history = H.split_history(fx.hot_log(spark, folder))
    return H.first_seen(history, "device_id", "is_new_device").rows().select(
        "transaction_id", "is_new_device")


def new_location_flags(spark, folder):
    history = H.split_history(fx.hot_log(spark, folder))
    return H.first_seen(history, "location", "is_new_location").rows().select(
        "transaction_id", "is_new_location")


def _episode_features(spark, folder):
    log, large = _episodes(spark, folder)
    return FT.point_features(log, fx.episode_home(), large=large)


def feat_amount_zscore(spark, folder):
    return _rounded(_episode_features(spark, folder).select(
        "transaction_id", "amount_zscore"), ["amount_zscore"])


def feat_amount_pct(spark, folder):
    return _rounded(_episode_features(spark, folder).select(
        "transaction_id", "amount_pct_of_avg"), ["amount_pct_of_avg"])


def feat_hour_unusual(spark, folder):
    return _episode_features(spark, folder).select("transaction_id", "hour_is_unusual")


def feat_category_unusual(spark, folder):
    return _episode_features(spark, folder).select("transaction_id", "category_is_unusual")


def feat_foreign_location(spark, folder):
    return FT.point_features(fx.orders_log(spark, folder), fx.orders_home()).select(
        "transaction_id", "is_foreign_location")


def feat_velocity_1h(spark, folder):
    return _episode_features(spark, folder).select("transaction_id", "txn_velocity_1h")


def feat_velocity_1h_ties(spark, folder):
    return FT.point_features(fx.orders_log(spark, folder), fx.orders_home()).select(
        "transaction_id", "txn_velocity_1h")


def failed_logins_24h_derived(spark, folder):
    return FT.failed_logins_trailing(
        fx.hot_log(spark, folder), F.col("merchant_category") == "error").select(
            "transaction_id", "failed_logins_24h")


def point_features(spark, folder):
    return _rounded(_episode_features(spark, folder).select(
        "customer_id", "transaction_id", *C.FEATURES, "is_fraud"),
        ["amount_zscore", "amount_pct_of_avg"])


def point_features_orders(spark, folder):
    rows = FT.point_features(fx.orders_log(spark, folder), fx.orders_home())
    return _rounded(rows.select("customer_id", "transaction_id", *C.FEATURES, "is_fraud"),
                    ["amount_zscore", "amount_pct_of_avg"])


def point_features_hot(spark, folder):
    rows = FT.point_features(fx.hot_log(spark, folder), fx.hot_home())
    return _rounded(rows.select("customer_id", "transaction_id", *C.FEATURES, "is_fraud"),
                    ["amount_zscore", "amount_pct_of_avg"])


def _skewed_run(spark, folder):
    """Run size that cuts the customer with a third of all rows and no other."""
    return max(200, fx.table(spark, folder, "events").count() // 10)


def point_features_skewed(spark, folder):
    rows = FT.point_features(fx.skewed_log(spark, folder), fx.hot_home(),
                             max_rows=_skewed_run(spark, folder))
    return _rounded(rows.select("customer_id", "transaction_id", *C.FEATURES, "is_fraud"),
                    ["amount_zscore", "amount_pct_of_avg"])


def scores_skewed(spark, folder):
    """Risk and similarity of every row where one customer has a third of all rows."""
    rows = scoring.behaviour(fx.skewed_log(spark, folder), fx.hot_home(),
                             max_rows=_skewed_run(spark, folder)).rows()
    risk = L.fixed_trajectory_model().risk_score(F.col("steps"))
    return P.add_similarity(rows.withColumn("risk_score", risk), digits=6).select(
        "transaction_id", "risk_score", "similarity_pct", "avg_z_deviation")


def scores_skewed_null_key(spark, folder):
    """Features, risk and similarity where the customer with a third of all rows is null."""
    rows = scoring.behaviour(fx.skewed_null_log(spark, folder), fx.hot_home(),
                             max_rows=_skewed_run(spark, folder)).rows()
    risk = L.fixed_trajectory_model().risk_score(F.col("steps"))
    return _rounded(P.add_similarity(rows.withColumn("risk_score", risk), digits=6), [
        "amount_zscore", "amount_pct_of_avg"]).select(
        "customer_id", "transaction_id", *C.FEATURES, "risk_score", "similarity_pct",
        "avg_z_deviation")


def fraud_rings_in_parts(spark, folder):
    """The customers of each ring in lists of twenty, in order across lists."""
    members = R.ring_members(R.device_counts(fx.hot_log(spark, folder)))
    return R.ring_pages(members, 20).withColumn("customer_ids", F.array_join("customer_ids", ","))


def feature_summary(spark, folder):
    summary = E.feature_summary(feature_table(spark, folder), [*C.FEATURES, "is_fraud"])
    return _rounded(summary, ["mean", "std", "min", "q25", "q50", "q75", "max"])


def feature_summary_daily(spark, folder):
    """Columns summed from a table of days, beside the exact quartiles.

    The table gets the days one half after the other, and the last day of the first
    half once more, as when its late rows have come.
    """
    features, columns = feature_table(spark, folder), [*C.FEATURES, "is_fraud"]
    day, half, late = F.to_date("timestamp"), F.lit(DAILY_HALF).cast("date"), F.col("transaction_id") % 5 == 0
    store = writers.daily_table(new_folder(spark, "daily"))
    for rows in (features.filter((day < half) | (day == half) & ~late), features.filter(day == half),
                 features.filter(day > half)):
        store.put(D.daily_values(rows, day, columns))
    found = _rounded(D.value_summary(store.read(spark)), ["mean", "std", "min", "q25", "q50", "q75", "max"])
    exact = E.feature_summary(features, columns).select(
        "feature", *[F.round(q, 6).alias(f"{q}_exact") for q in ("q25", "q50", "q75")])
    return found.join(exact, "feature")


def auc_weekly(spark, folder):
    """Area under the curve of each week from counts per day, its greatest error, and the exact area."""
    rows, day = _test_scores(spark, folder), F.to_date("timestamp")
    week = F.date_format(F.date_trunc("week", F.col("day")), "yyyy-MM-dd")
    found = D.auc_summary(D.daily_scores(rows, day, "probability", "is_fraud").withColumn("week", week), "week")
    exact = E.auc_by(rows.withColumn("day", day).withColumn("week", week), "week", "probability", "is_fraud")
    return _rounded(found.join(exact.withColumnRenamed("auc_roc", "auc_exact"), "week"),
                    ["auc_roc", "auc_error", "auc_exact"])


def dataset_size(spark, folder):
    return E.dataset_size(fx.episode_log(spark, folder))


def sequences_long(spark, folder):
    log, large = _episodes(spark, folder)
    history = FT.add_point_features(FT.log_history(log, large=large), fx.episode_home())
    return _rounded(S.long_form(S.sequences(history)), ["amount_zscore", "amount_pct_of_avg"])


def sequences_long_orders(spark, folder):
    history = FT.add_point_features(
        FT.log_history(fx.orders_log(spark, folder)), fx.orders_home())
    return _rounded(S.long_form(S.sequences(history)), ["amount_zscore", "amount_pct_of_avg"])


def sequence_label_rate(spark, folder):
    return scoring.hand_off(feature_table(spark, folder)).agg(
        F.count("*").alias("n_sequences"), F.lit(C.SEQUENCE_LENGTH).alias("steps"),
        F.lit(len(C.FEATURES)).alias("features"),
        F.round(F.avg("is_fraud") * 100, 2).alias("fraud_rate_pct"))


def latest_sequence_padded(spark, folder):
    features = FT.point_features(fx.orders_log(spark, folder), fx.orders_home())
    return _rounded(S.long_form(S.latest_sequence(features)),
                    ["amount_zscore", "amount_pct_of_avg"])


def customer_profile(spark, folder):
    profile = P.long_profile(P.customer_profile(feature_table(spark, folder)))
    return _rounded(profile, ["mean", "std"])


def profile_prefix(spark, folder):
    features = FT.point_features(fx.orders_log(spark, folder), fx.orders_home())
    return _rounded(P.long_profile(P.customer_profile(features, first_rows=5)), ["mean", "std"])


def similarity(spark, folder):
    log, large = _episodes(spark, folder)
    history = FT.add_point_features(FT.log_history(log, large=large), fx.episode_home())
    return P.add_similarity(P.add_profile(history.settled()).rows(), digits=6).select(
        "transaction_id", "similarity_pct", "deviation_pct", "avg_z_deviation")


def split_counts(spark, folder):
    return training_rows(spark, folder).groupBy("is_test", "is_fraud").agg(F.count("*").alias("n"))


def scaler_stats(spark, folder):
    rows = training_rows(spark, folder).filter("not is_test")
    return _rounded(L.scaler_stats(rows, C.MODEL_INPUTS), ["mean", "std"])


def seq_scaler_stats(spark, folder):
    log, large = _episodes(spark, folder)
    history = FT.add_point_features(FT.log_history(log, large=large), fx.episode_home())
    train_windows = L.add_split(S.sequences(history)).filter("not is_test")
    return _rounded(L.sequence_scaler_stats(train_windows), ["mean", "std"])


def class_weights(spark, folder):
    return _rounded(L.class_weights(training_rows(spark, folder).filter("not is_test")),
                    ["weight_pos"])


def background_sample(spark, folder):
    rows = training_rows(spark, folder).filter("not is_test")
    scaler = fixed_models(spark, folder).transaction.scaler
    return _rounded(L.background_sample(rows, scaler), C.MODEL_INPUTS)


def normalised_clipped(spark, folder):
    scaler = fixed_models(spark, folder).transaction.scaler
    inputs = [F.round(x, 6).alias(c)
              for c, x in zip(C.MODEL_INPUTS, L.normalised_inputs(scaler))]
    return feature_table(spark, folder).select("transaction_id", *inputs)


def risk_scores_fixed(spark, folder):
    log, large = _episodes(spark, folder)
    return scoring.with_risk(
        log, L.fixed_trajectory_model(), fx.episode_home(), large=large).select(
            "transaction_id", "risk_score")


def handoff_join(spark, folder):
    """Features joined with the risk scores of the rows that have a full window."""
    table = feature_table(spark, folder)
    risk = scoring.hand_off(table).select("transaction_id", "risk_score")
    features = table.drop("risk_score").select("transaction_id", *C.FEATURES, "is_fraud")
    return _rounded(features.join(risk, "transaction_id"),
                    ["amount_zscore", "amount_pct_of_avg"])


def fraud_prob_fixed(spark, folder):
    return _served(spark, folder).select(
        "transaction_id", F.round(F.col("_p") * 100, 2).alias("fraud_probability"))


def alert_levels(spark, folder):
    return _served(spark, folder).select(
        "transaction_id", alert_level(F.col("_p")).alias("alert_level"),
        gauge_band(F.col("risk_score")).alias("risk_band"))


def alert_summary(spark, folder):
    return scoring.batch_summary(_served(spark, folder).withColumn(
        "alert_level", alert_level(F.col("_p"))))


def logit_contributions(spark, folder):
    models = fixed_models(spark, folder)
    parts = X.logit_contributions(models.transaction, models.background)
    return feature_table(spark, folder).select(
        "transaction_id", *[F.round(p, 6).alias(c) for c, p in zip(C.MODEL_INPUTS, parts)])


def probability_contributions(spark, folder):
    models = fixed_models(spark, folder)
    rows = _served(spark, folder).filter(F.col("_p") >= C.REASON_THRESHOLD)
    explained = X.add_probability_contributions(rows, models.transaction, models.background)
    return explained.select("transaction_id", F.posexplode("contributions").alias(
        "position", "value")).select(
        "transaction_id", "position", F.round("value", 6).alias("contribution"))


def reasons_topk(spark, folder):
    return _rounded(X.reasons_long(scored_table(spark, folder)), ["attribution"])


def reasons_display(spark, folder):
    return X.reasons_for_display(scored_table(spark, folder))


def confusion(spark, folder):
    return E.confusion(_test_scores(spark, folder), "probability", "is_fraud")


def prf1(spark, folder):
    counts = E.confusion(_test_scores(spark, folder), "probability", "is_fraud")
    return E.rates(counts).select(
        "precision", "recall", "f1_score", "test_set_size", "fraud_rate_pct")


def auc_roc(spark, folder):
    return E.auc_roc(_test_scores(spark, folder), "probability", "is_fraud")


def fraud_rings(spark, folder):
    return R.rings(fx.episode_log(spark, folder))


def fraud_rings_min_k(spark, folder):
    return R.rings(fx.hot_log(spark, folder), min_customers=70)


def fraud_rings_orders(spark, folder):
    return R.rings(fx.orders_log(spark, folder))


def ring_members(spark, folder):
    return R.ring_members(R.device_counts(fx.hot_log(spark, folder)))


def customers_list(spark, folder):
    return reports.customers(fx.orders_log(spark, folder))


def customer_timeline(spark, folder):
    return reports.customer_timeline(scored_table(spark, folder), TIMELINE_CUSTOMER)


def _batch_scored(spark, folder):
    log, _ = _episodes(spark, folder)
    cut = F.to_timestamp_ntz(F.lit(BATCH_CUT))
    stored = log.filter(F.col("timestamp") < cut)
    batch = log.filter(F.col("timestamp") >= cut).drop("is_fraud")
    return scoring.score_batch(stored, batch, fixed_models(spark, folder), fx.episode_home(),
                               with_reasons=False)


def batch_score(spark, folder):
    return _batch_scored(spark, folder).select(
        "transaction_id", "customer_id", "amount", "risk_score", "fraud_probability",
        "alert_level")


def batch_score_summary(spark, folder):
    return scoring.batch_summary(_batch_scored(spark, folder))


def scored_log(spark, folder):
    return _scored(spark, folder, False)


def report_rows(spark, folder):
    return reports.report_rows(scored_table(spark, folder))


def json_requests(spark, folder):
    """Batch rows written as request bodies and read back."""
    batch = fx.dirty_batch(spark, folder).select(
        "customer_id", F.col("transaction_id").cast("string").alias("transaction_id"),
        "amount", "merchant_category", "device_id", "location", "failed_logins_24h")
    bodies = batch.select(F.to_json(F.struct(*batch.columns)).alias("value"))
    return transactions_json(bodies).drop("timestamp").withColumn(
        "failed_logins_24h", F.col("failed_logins_24h").cast("string"))


def scored_json(spark, folder):
    bodies = scored_as_json(scored_table(spark, folder))
    reasons = "array<struct<feature:string,attribution:double>>"
    parsed = F.from_json("body", f"transaction_id bigint, alert_level string, reasons {reasons}")
    return bodies.select(parsed.alias("b")).select(
        "b.transaction_id", "b.alert_level", F.size("b.reasons").alias("n_reasons"))


def trained_metrics(spark, folder):
    return trained(spark, folder).metrics()


def trained_scores(spark, folder):
    """The whole log scored and explained with the trained models."""
    return scoring.score_log(fx.episode_log(spark, folder), trained(spark, folder).models,
                             fx.episode_home())


def trained_optimum(spark, folder):
    """Whether each coefficient of the fitted transaction model is at its optimum."""
    fitted = trained(spark, folder)
    rows = fitted.table.filter("not is_test")
    return L.stationarity(rows, fitted.models.transaction).select(
        "position", "input", (F.col("gradient") < 1e-3).alias("at_optimum")).join(
        rows.agg(F.count("*").alias("n_rows")))


def boosted(spark: SparkSession, folder: str) -> tuple[TR.TreeModel, list[list[float]]]:
    """The boosted model of the training rows and its scaled background rows."""
    def build():
        rows = training_rows(spark, folder).filter("not is_test")
        model = BT.fit_boosted_model(rows).portable()
        return model, L.read_background(L.background_sample(rows, model.scaler))
    return _keep(spark, folder, "boosted", build)


def boosted_parts(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """Contributions to the boosted score of the rows `asked`, and whether they add up to it."""
    model, background = boosted(spark, folder)
    rows = X.add_probability_contributions(asked, model, background)
    base = sum(1 / (1 + math.exp(-model.background_value(b))) for b in background) / len(background)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
    return rows.select("transaction_id", "score", "contributions",
                       (F.abs(total - (F.col("score") - base)) < 1e-6).alias("adds_up"))


def boosted_rows(spark: SparkSession, folder: str, condition: str) -> DataFrame:
    """Rows of the log that meet the condition, with their boosted score."""
    model, _ = boosted(spark, folder)
    score = model.probability(L.normalised_inputs(model.scaler))
    return training_rows(spark, folder).withColumn("score", score).filter(condition).select(
        "transaction_id", "score", *C.MODEL_INPUTS)


def tree_models(spark: SparkSession, folder: str) -> L.RiskModels:
    """The fixed models with trees as the second stage."""
    models = fixed_models(spark, folder)
    return L.RiskModels(models.trajectory, TR.fixed_tree_model(models.transaction.scaler), models.background)


def risk_scores_trees(spark, folder):
    """The trajectory risk of every row under fixed trees on the window."""
    log, large = _episodes(spark, folder)
    return scoring.with_risk(log, TJ.fixed_trajectory_trees(), fx.episode_home(), large=large).select(
        "customer_id", "transaction_id", "n_prior", "risk_score")


def trajectory_steps(spark, folder):
    """The validation AUC of stage 1 after each tree, which steps were watched and which one is kept."""
    log = fx.episode_log(spark, folder)
    history = FT.add_point_features(FT.log_history(log), fx.episode_home())
    rows = L.add_split(S.sequences(history)).filter("not is_test")
    grown = TJ.grow_trajectory_trees(materialize(rows, "windows"), max_steps=15)
    return spark.createDataFrame(
        [(step, round(auc, 6), step <= grown.stopped, step == grown.chosen) for step, auc in grown.curve],
        "step int, validation_auc double, watched boolean, chosen boolean")


def tree_models_round_trip(spark, folder):
    """A tree model stored, loaded and used by the scoring of a log."""
    path = new_folder(spark, "models")
    writers.save_models(spark, tree_models(spark, folder), path)
    return scoring.score_features(
        feature_table(spark, folder), writers.load_models(spark, path), _episodes(spark, folder)[1],
        with_reasons=False).select("transaction_id", "risk_score", "fraud_probability", "similarity_pct",
                                   "alert_level")


def tree_attribution(spark, folder):
    """Every input's part in the probability of the fixed trees, for every row above the threshold."""
    models = tree_models(spark, folder)
    rows = training_rows(spark, folder).filter("is_test").withColumn(
        "_p", models.transaction.served_probability()).filter(F.col("_p") >= C.REASON_THRESHOLD)
    got = X.add_probability_contributions(rows, models.transaction, models.background)
    return got.select("transaction_id", F.round(F.col("_p") + 1e-9, 6).alias("probability"), *[
        F.round(F.get("contributions", F.lit(i)) + 1e-9, 6).alias(f"by_{c}")
        for i, c in enumerate(C.MODEL_INPUTS)])


def boosted_attribution(spark, folder):
    """Reasons of the marked held-out rows under boosted trees: they add up to the score.

    The rows are those that SQL can name; `boosted_reasons` has all that need reasons.
    """
    return boosted_parts(spark, folder, boosted_rows(spark, folder, "is_test and is_fraud = 1")).select(
        "transaction_id", F.size("contributions").alias("n_inputs"), "adds_up")


def boosted_reasons(spark, folder):
    """Reasons of every row whose boosted score reaches the threshold, whatever its label."""
    asked = materialize(boosted_rows(spark, folder, f"score >= {C.REASON_THRESHOLD}"), "boosted-asked")
    return boosted_parts(spark, folder, asked)


def trained_held_out(spark, folder):
    """Size, labels and fraud rate of the held-out rows, and whether the models rank them well."""
    return trained(spark, folder).metrics().select(
        "model", "test_set_size", "fraud_rate_pct", "threshold",
        (F.col("confusion_matrix.false_negative") + F.col("confusion_matrix.true_positive"))
        .alias("n_fraud"), (F.col("auc_roc") > 0.7).alias("ranks_well"))


def stream_score(spark, folder):
    log = fx.episode_log(spark, folder)
    return replay.scored(spark, log, fixed_models(spark, folder)).select(
        "transaction_id", "risk_score", "fraud_probability", "similarity_pct", "alert_level")


def stream_alert_counts(spark, folder):
    return replay.alert_counts(spark, fx.episode_log(spark, folder), fixed_models(spark, folder))


def stream_rings(spark, folder):
    return replay.rings(spark, fx.episode_log(spark, folder))


# --- tables written and read back through the real readers and writers ------------

LOG_COLUMNS = ["customer_id", "transaction_id", "timestamp", "amount", "merchant_category",
               "device_id", "location", "failed_logins_24h", "is_fraud"]


def csv_log_round_trip(spark, folder):
    """The log as a CSV file with its header, read with the schema of the log."""
    log = fx.hot_log(spark, folder)
    path = new_folder(spark, "log-csv")
    log.select(*[
        (F.lit(0) if c not in log.columns else F.col(c)).alias(c) for c in C.TRANSACTION_SCHEMA.names
    ]).write.option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    return readers.transactions_csv(spark, path).select(
        *[F.col(c).cast("timestamp_ntz") if c == "timestamp" else F.col(c) for c in LOG_COLUMNS])


def feature_store_round_trip(spark, folder):
    """The feature table written in customer order and read back."""
    path = new_folder(spark, "feature-store")
    writers.write_features(feature_table(spark, folder), path)
    return _rounded(readers.transactions_parquet(spark, path).select(
        "customer_id", "transaction_id", *C.FEATURES, "is_fraud"),
        ["amount_zscore", "amount_pct_of_avg"])


def sequence_store_round_trip(spark, folder):
    """Windows, labels and keys in one stored table."""
    path = new_folder(spark, "sequence-store")
    log, large = _episodes(spark, folder)
    history = FT.add_point_features(FT.log_history(log, large=large), fx.episode_home())
    writers.write_sequences(S.sequences(history), path)
    return spark.read.parquet(path).select(
        "customer_id", "transaction_id", F.size("seq").alias("steps"),
        F.round(F.aggregate("seq", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(7))), 6)
        .alias("velocity_sum"), "label")


def _as_text(batch):
    return batch.select(*[F.col(c).cast("string").alias(c) for c in batch.columns])


def batch_csv_mixed_headers(spark, folder):
    """Files of one folder whose headers differ in order and in optional columns."""
    batch = _as_text(fx.dirty_batch(spark, folder).select(
        "customer_id", "amount", "merchant_category", "device_id", "location", "transaction_id"))
    path = new_folder(spark, "batch-csv")
    even = F.col("transaction_id") % 2 == 0
    orders = [batch.filter(even), batch.filter(~even).select(
        "location", "transaction_id", "device_id", "customer_id", "merchant_category", "amount"),
        batch.filter(even).select("merchant_category", "amount", "customer_id").limit(0)]
    for part in orders:
        part.write.mode("append").option("header", True).csv(path)
    rows = readers.well_formed(readers.batch_csv(spark, path))
    return rows.select("transaction_id", "customer_id", F.col("amount").cast("double").alias("amount"),
                       "merchant_category", F.nullif("device_id", F.lit("")).alias("device_id"),
                       "location")


def batch_unparsed_values(spark, folder):
    """Values of an uploaded file that do not parse, beside the rules that rows break."""
    batch = fx.dirty_batch(spark, folder)
    odd = F.col("transaction_id") % 7 == 0
    text = _as_text(batch.drop("timestamp")).withColumn(
        "amount", F.when(odd, "ten").otherwise(F.col("amount"))).withColumn(
        "failed_logins_24h", F.when(F.col("transaction_id") % 11 == 0, "many").otherwise(
            F.col("failed_logins_24h")))
    path = new_folder(spark, "batch-csv")
    text.write.option("header", True).csv(path)
    rows = V.with_violations(readers.well_formed(readers.batch_csv(spark, path)))
    return rows.filter(F.size("violations") > 0).select(
        "transaction_id", F.array_join("violations", "; ").alias("violations"))


def missing_columns(spark, folder):
    """Required batch columns that each table lacks, with the rows that would be refused."""
    parts = []
    for name in ("events", "orders", "customer", "lineitem"):
        rows = fx.table(spark, folder, name).withColumnsRenamed(
            {"user_id": "customer_id", "o_custkey": "customer_id", "value": "amount"})
        try:
            V.check_columns(rows.columns)
            message = ""
        except ValueError as error:
            message = str(error)
        parts.append(rows.agg(F.lit(name).alias("table_name"), F.lit(message).alias("message"),
                              F.count("*").alias("n_rows")))
    return reduce(DataFrame.unionByName, parts)


def features_recomputed(spark, folder):
    """Features of a table that has them already: the columns are replaced."""
    wrong = feature_table(spark, folder).withColumns(
        {c: F.lit(-1) for c in C.FEATURES if c != "failed_logins_24h"})
    return _rounded(FT.point_features(wrong, fx.episode_home()).select(
        "customer_id", "transaction_id", *C.FEATURES, "is_fraud"),
        ["amount_zscore", "amount_pct_of_avg"])


def models_round_trip(spark, folder):
    """Both models with scaler and background stored, loaded and used for scoring."""
    path = new_folder(spark, "models")
    writers.save_models(spark, fixed_models(spark, folder), path)
    loaded = writers.load_models(spark, path)
    return feature_table(spark, folder).select(
        "transaction_id",
        F.round(loaded.transaction.served_probability() * 100, 2).alias("fraud_probability"))


def background_stored(spark, folder):
    """The background rows as they are in a stored model."""
    path = new_folder(spark, "models")
    writers.save_models(spark, fixed_models(spark, folder), path)
    rows = writers.load_models(spark, path).background
    numbers = F.from_json(F.lit(json.dumps([list(map(float, r)) for r in rows])), "array<array<double>>")
    return feature_table(spark, folder).agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.size(numbers).alias("n_background"),
        *[F.round(F.aggregate(F.transform(numbers, _at(i)), F.lit(0.0), lambda a, v: a + v), 4)
          .alias(f"sum_{c}") for i, c in enumerate(C.MODEL_INPUTS)])


def _at(i):
    return lambda row: F.get(row, F.lit(i))


def metrics_refresh(spark, folder):
    """Stored metrics stay until a refresh: computed on a part, kept, then refreshed."""
    path = new_folder(spark, "metrics")

    def compute(share):
        rows = _test_scores(spark, folder).filter(F.pmod("transaction_id", F.lit(share)) == 0)
        return lambda: E.metrics(rows, "probability", "is_fraud", "transaction")

    first = reports.stored_metrics(spark, path, compute(2)).withColumn("version", F.lit("first"))
    first = materialize(first, "metrics")
    kept = reports.stored_metrics(spark, path, compute(1)).withColumn("version", F.lit("kept"))
    kept = materialize(kept, "metrics")
    fresh = reports.stored_metrics(spark, path, compute(1), refresh=True).withColumn(
        "version", F.lit("refreshed"))
    return first.unionByName(kept).unionByName(fresh).select(
        "version", "model", "precision", "recall", "f1_score", "auc_roc", "confusion_matrix.*",
        "test_set_size", "fraud_rate_pct", "threshold")


def history_from_nothing(spark, folder):
    """A first batch against a history that has not been stored yet."""
    empty = readers.stored_history(spark, new_folder(spark, "no-history"))
    batch = fx.hot_log(spark, folder).select(
        *[F.col(c).cast("string") if c in ("customer_id", "transaction_id") else F.col(c)
          for c in LOG_COLUMNS])
    return empty.select(*LOG_COLUMNS).unionByName(
        batch.withColumn("timestamp", F.col("timestamp").cast("timestamp"))).groupBy(
        "customer_id").agg(F.count("*").alias("n_rows"))


def batch_default_time(spark, folder):
    """Rows without a time are placed at the time of the run."""
    batch = fx.dirty_batch(spark, folder)
    gone = batch.withColumn("timestamp", F.when(
        F.col("transaction_id") % 3 > 0, F.col("timestamp").cast("timestamp")))
    filled = V.with_defaults(V.check_rows(gone).valid)
    recent = F.col("timestamp") > F.current_timestamp() - F.expr("interval 1 day")
    return filled.select("transaction_id", recent.alias("is_now"))


def generated_ids_of_requests(spark, folder):
    """Equal rows without an id and a time get ids of their own, the same in every run."""
    requests = fx.dirty_batch(spark, folder).select(
        F.lit("C1").alias("customer_id"), F.lit(10.0).alias("amount"), "merchant_category")

    def ids():
        return V.with_defaults(V.check_rows(requests).valid).select("transaction_id", "merchant_category")

    again = ids().select("transaction_id").distinct().withColumn("again", F.lit(1))
    return ids().join(again, "transaction_id", "left").groupBy("merchant_category").agg(
        F.count("*").alias("n_rows"), F.countDistinct("transaction_id").alias("n_ids"),
        F.sum("again").alias("n_again"))


def append_scored_twice(spark, folder):
    """A scored store that gets every row again, on another date, beside rows sent twice."""
    path = new_folder(spark, "scored-store")
    rows = scored_table(spark, folder).select(*C.SCORED_COLUMNS)
    early = F.col("transaction_id") % 2 == 0
    writers.append_scored(rows.filter(early).unionByName(rows.filter(early)), path)
    later = rows.withColumn("timestamp", F.col("timestamp") + F.expr("interval 3 days"))
    writers.append_scored(later.unionByName(later.filter(~early)), path)
    return writers.read_scored(spark, path).select(
        "transaction_id", "customer_id", "timestamp", "fraud_probability", "alert_level")


def customer_timeline_stored(spark, folder):
    """A customer's timeline from the store, which reads that customer's bucket only."""
    path = new_folder(spark, "scored-store")
    writers.append_scored(scored_table(spark, folder), path)
    return reports.customer_timeline(
        writers.scored_of_customer(spark, path, TIMELINE_CUSTOMER), TIMELINE_CUSTOMER)


def conflicting_ids(spark, folder):
    """Ids that a batch brings with different content."""
    rows = scored_table(spark, folder).select(*C.SCORED_COLUMNS)
    other = rows.filter(F.col("transaction_id") % 5 == 0).withColumn("amount", F.col("amount") + 1)
    return writers.conflicting_ids(rows.unionByName(rows).unionByName(other))


def stream_score_delayed(spark, folder):
    """Shuffled arrivals over several micro-batches, taken in event order within a delay."""
    return replay.scored_in_order(spark, folder, fixed_models(spark, folder)).select(
        "transaction_id", "risk_score", "fraud_probability", "similarity_pct", "alert_level",
        "is_late")


# --- behaviour carried forward: batches and streams that start from a snapshot ---------

HALF = "2024-01-16 00:00:00"


def _before(at: str):
    return F.col("timestamp") < F.to_timestamp_ntz(F.lit(at))


def _snapshot(spark, log, path, home, max_rows=None):
    """The snapshot of a log, written to the store of snapshots and read back.

    The behaviour is written once: the parts of a snapshot each read it.
    """
    rows = materialize(scoring.behaviour(log, home, max_rows).rows(), "behaviour")
    writers.put_snapshot(SN.snapshot_of(rows), path)
    return writers.read_snapshot(spark, path)


BATCH_SHOWN = ["transaction_id", "customer_id", "amount", "risk_score", "fraud_probability",
               "similarity_pct", "alert_level"]


def batch_score_from_snapshot(spark, folder):
    """A batch scored from the stored snapshot; a fifth of its customers also bring back-dated rows."""
    log = fx.episode_log(spark, folder)
    held = (F.col("customer_id") % 5 == 0) & F.dayofmonth("timestamp").between(9, 10)
    in_batch = ~_before(BATCH_CUT) | held
    stored, batch = log.filter(~in_batch), log.filter(in_batch).drop("is_fraud")
    home = fx.episode_home()
    snapshot = _snapshot(spark, stored, new_folder(spark, "snapshots"), home)
    return scoring.score_batch(stored, batch, fixed_models(spark, folder), home, with_reasons=False,
                               snapshot=snapshot).select(*BATCH_SHOWN)


def batch_score_carried(spark, folder):
    """Two batches in a row; the first one's snapshot is written and the second starts from it."""
    log, home, path = fx.episode_log(spark, folder), fx.episode_home(), new_folder(spark, "snapshots")
    models, parts = fixed_models(spark, folder), []
    stored = log.filter(_before(HALF))
    snapshot = _snapshot(spark, stored, path, home)
    for number, arrived in enumerate((_before(BATCH_CUT) & ~_before(HALF), ~_before(BATCH_CUT))):
        carried = scoring.carry_batch(snapshot, stored, log.filter(arrived).drop("is_fraud"), models, home,
                                      with_reasons=False)
        parts.append(materialize(carried.scored, "scored"))
        writers.put_snapshot(carried.changed, path, number, "batches")
        snapshot, stored = writers.read_snapshot(spark, path), log.filter(_before(BATCH_CUT))
    return parts[0].unionByName(parts[1]).select(*BATCH_SHOWN)


def customer_snapshots(spark, folder):
    """The merged snapshot of two halves of the skewed log, the large customer cut into runs."""
    log = fx.skewed_log(spark, folder)
    rows = materialize(scoring.behaviour(log, fx.hot_home(), _skewed_run(spark, folder)).rows(), "behaviour")
    both = SN.merge_snapshots(SN.snapshot_of(rows.filter(_before(HALF))), SN.snapshot_of(rows.filter(~_before(HALF))))
    used = both.values.groupBy("customer_id").agg(
        F.count("*").alias("n_values"), F.sum("n").alias("n_uses"))
    # The small number keeps exact halves away from the rounding.
    parts = [F.round(F.get("f_mean", F.lit(i)) + 1e-9, 6).alias(f"mean_{f}") for i, f in enumerate(C.FEATURES)]
    return both.customers.join(used, "customer_id").select(
        "customer_id", "n", F.round(F.col("mean") + 1e-9, 6).alias("mean"),
        F.round(F.sqrt(F.col("m2") / F.col("n")) + 1e-9, 6).alias("std"),
        "last", F.size("recent").alias("n_recent"), F.size("steps").alias("n_steps"),
        F.get("hours", F.lit(12)).alias("n_at_noon"), "n_values", "n_uses", *parts)


def stream_score_continued(spark, folder):
    """The second half of the log as a stream that starts from the snapshot of the first."""
    log, home = fx.episode_log(spark, folder), fx.episode_home()
    snapshot = _snapshot(spark, log.filter(_before(HALF)), new_folder(spark, "snapshots"), home)
    return replay.scored(spark, log.filter(~_before(HALF)), fixed_models(spark, folder), snapshot).select(
        "transaction_id", "risk_score", "fraud_probability", "similarity_pct", "alert_level")


def stream_behaviour_continued(spark, folder):
    """Likewise where one customer, cut into runs for the snapshot, has a third of all rows."""
    log, home = fx.skewed_log(spark, folder), fx.hot_home()
    snapshot = _snapshot(spark, log.filter(_before(HALF)), new_folder(spark, "snapshots"), home,
                         _skewed_run(spark, folder))
    rows = replay.behaviour(spark, log.filter(~_before(HALF)), home, snapshot)
    risk = L.fixed_trajectory_model().risk_score(F.col("steps"))
    return _rounded(P.add_similarity(rows.withColumn("risk_score", risk), digits=6), [
        "amount_zscore", "amount_pct_of_avg"]).select(
        "customer_id", "transaction_id", *C.FEATURES, "risk_score", "similarity_pct")


def stream_checked_scored(spark, folder):
    """The valid rows of a raw stream; broken ones among them leave no trace in the state."""
    return replay.checked(spark, fx.dirty_batch(spark, folder), fixed_models(spark, folder))[0].select(
        "customer_id", "transaction_id", "device_id", "location", "failed_logins_24h", "risk_score",
        "similarity_pct")


def stream_rejected(spark, folder):
    """The broken rows of a raw stream with their rules, as the sink beside the scores has them."""
    return replay.checked(spark, fx.dirty_batch(spark, folder), fixed_models(spark, folder))[1].select(
        "transaction_id", F.array_join("violations", "; ").alias("violations"),
        F.get_json_object("given", "$.merchant_category").alias("given_category"))


QUERIES: list[Query] = [
    batch_score_from_snapshot, batch_score_carried, customer_snapshots, stream_score_continued,
    stream_behaviour_continued, stream_checked_scored, stream_rejected,
    tree_models_round_trip, tree_attribution, risk_scores_trees, trajectory_steps,
    csv_log_round_trip, feature_store_round_trip, sequence_store_round_trip,
    batch_csv_mixed_headers, batch_unparsed_values, missing_columns, features_recomputed,
    models_round_trip, background_stored, metrics_refresh, history_from_nothing,
    batch_default_time, generated_ids_of_requests, append_scored_twice,
    customer_timeline_stored, conflicting_ids, stream_score_delayed,
    txn_canonical, contract_violations, violation_counts, batch_defaults, generated_ids,
    sequential_ids, new_device_flags, new_location_flags, feat_amount_zscore,
    feat_amount_pct, feat_hour_unusual, feat_category_unusual, feat_foreign_location,
    feat_velocity_1h, feat_velocity_1h_ties, failed_logins_24h_derived, point_features,
    point_features_orders, point_features_hot, point_features_skewed, scores_skewed,
    scores_skewed_null_key,
    feature_summary, feature_summary_daily, auc_weekly, dataset_size,
    sequences_long, sequences_long_orders, sequence_label_rate, latest_sequence_padded,
    customer_profile, profile_prefix, similarity, split_counts, scaler_stats,
    seq_scaler_stats, class_weights, background_sample, normalised_clipped,
    risk_scores_fixed, handoff_join, fraud_prob_fixed, alert_levels, alert_summary,
    logit_contributions, probability_contributions, reasons_topk, reasons_display,
    confusion, prf1, auc_roc, fraud_rings, fraud_rings_min_k, fraud_rings_orders,
    fraud_rings_in_parts, ring_members, customers_list, customer_timeline, batch_score, batch_score_summary,
    scored_log, report_rows, json_requests, scored_json, trained_optimum, trained_held_out,
    boosted_attribution, boosted_reasons, trained_metrics, trained_scores,
    stream_score, stream_alert_counts, stream_rings,
]


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(apply_settings(spark), folder)
    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


def all_queries() -> dict[str, Query]:
    return {q.__name__: _prepared(q) for q in QUERIES}
