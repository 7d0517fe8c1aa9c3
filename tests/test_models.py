import math

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.functions.columns import alert_level, gauge_band
from spendtrace.operators import evaluate as E
from spendtrace.operators import explain as X
from spendtrace.operators import boosted as B
from spendtrace.operators import learn as L
from spendtrace.operators import stored
from checks import catalog
from spendtrace.plans import reports

PLAIN = [(0.0, 1.0)] * 10


def inputs(spark, vectors):
    rows = [(f"t{i}", *[float(v) for v in vector]) for i, vector in enumerate(vectors)]
    return spark.createDataFrame(
        rows, "transaction_id string, " + ", ".join(f"{c} double" for c in C.MODEL_INPUTS))


def test_alert_levels_at_the_cuts(spark):
    given = [0.2499999, 0.25, 0.4999, 0.5, 0.8, 0.999]
    rows = spark.createDataFrame([(p,) for p in given], "p double")
    got = [r[0] for r in rows.select(alert_level(F.col("p"))).collect()]
    assert got == ["Low Risk", "Medium Risk", "Medium Risk", "High Risk",
                   "Critical Risk", "Critical Risk"]


def test_gauge_puts_a_cut_in_the_lower_band(spark):
    rows = spark.createDataFrame([(v,) for v in (25.0, 25.1, 50.0, 80.0, 80.1, 140.0)], "s double")
    got = [r[0] for r in rows.select(gauge_band(F.col("s"))).collect()]
    assert got == ["low", "medium", "medium", "high", "critical", "critical"]


def test_probability_is_capped_and_inputs_are_limited(spark):
    model = L.TransactionModel(0.0, [1.0] * 10, PLAIN)
    rows = inputs(spark, [[1e9] * 10, [0.1] * 10])
    got = [r[0] for r in rows.select(model.served_probability()).collect()]
    assert got[0] == 0.999 and got[1] == pytest.approx(1 / (1 + math.exp(-1.0)))


def test_scaler_uses_population_deviation_and_floor(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = {r.feature: (r.mean, r.std) for r in L.scaler_stats(rows, ["a", "b"]).collect()}
    assert got == {"a": (2.0, 1.0), "b": (5.0, 1.0)}


def test_class_weight_is_at_least_one(spark):
    def weight(labels):
        rows = spark.createDataFrame([(v,) for v in labels], "is_fraud int")
        return L.class_weights(rows).first().weight_pos
    assert weight([1, 0, 0, 0]) == 3.0
    assert weight([1, 1, 1, 0]) == 1.0
    assert weight([0, 0]) == 2.0


def test_models_survive_text(spark):
    models = L.RiskModels(L.fixed_trajectory_model(), L.fixed_transaction_model(PLAIN),
                          [[0.5] * 10])
    assert stored.from_json(stored.to_json(models)) == models


def test_trajectory_model_matches_plain_sum(spark):
    model = L.TrajectoryModel(0.3, [[0.01 * (k + j) for j in range(9)] for k in range(10)],
                              [(0.5, 2.0)] * 9)
    steps = [[float(j + k) for j in range(9)] for k in range(4)]
    rows = spark.createDataFrame([(steps,)], "steps array<array<double>>")
    window = [steps[0]] * 6 + steps
    logit = 0.3 + sum(0.01 * (k + j) * (window[k][j] - 0.5) / 2.0
                      for k in range(10) for j in range(9))
    got = rows.select(model.probability(F.col("steps"))).first()[0]
    assert got == pytest.approx(1 / (1 + math.exp(-logit)))


def test_contributions_add_up_and_match_integration(spark):
    weights = [0.8, -0.5, 0.3, 0.0, 0.6, 0.2, -0.1, 0.4, 0.9, 0.7]
    model = L.TransactionModel(-1.0, weights, PLAIN)
    background = [[0.1 * i * (j % 3) for j in range(10)] for i in range(5)]
    point = [1.0, 0.5, -0.2, 2.0, 1.5, 0.0, 0.3, 0.9, -1.1, 2.2]
    got = X.add_probability_contributions(
        inputs(spark, [point]), model, background).first().contributions

    def p(v):
        return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(v, weights)) - 1.0)))

    rise = p(point) - sum(p(b) for b in background) / len(background)
    assert sum(got) == pytest.approx(rise)
    n = 2000
    for i in range(10):
        area = 0.0
        for b in background:
            for s in range(n):
                a = (s + 0.5) / n
                at = p([y + a * (x - y) for x, y in zip(point, b)])
                area += (point[i] - b[i]) * at * (1 - at) * weights[i] / n
        assert got[i] == pytest.approx(area / len(background), abs=1e-6)


def test_point_equal_to_background_has_no_contribution(spark):
    model = L.TransactionModel(0.0, [1.0] * 10, PLAIN)
    got = X.add_probability_contributions(
        inputs(spark, [[0.5] * 10]), model, [[0.5] * 10]).first().contributions
    assert got == pytest.approx([0.0] * 10)


def test_logit_contributions_add_up(spark):
    model = L.TransactionModel(-1.0, [0.1 * i for i in range(10)], PLAIN)
    background = [[0.0] * 10, [1.0] * 10]
    point = [float(i % 3) for i in range(10)]
    parts = X.logit_contributions(model, background)
    got = inputs(spark, [point]).select(*parts).first()
    mean = sum(model.background_value(b) for b in background) / 2
    assert sum(got) == pytest.approx(model.background_value(point) - mean)


def test_reasons_are_positive_sorted_and_four(spark):
    # Fixed input: given contributions.
    values = [0.1, -0.2, 0.5, 0.0, 0.3, 0.2, 0.05, 0.4, -0.1, 0.01]
    rows = spark.createDataFrame([(values,), ([-0.1] * 10,), (None,)], "c array<double>")
    got = [r[0] for r in rows.select(X.top_reasons(F.col("c"))).collect()]
    assert [(r.feature, r.display_name) for r in got[0]] == [
        ("is_new_device", "New Device"), ("txn_velocity_1h", "High Transaction Velocity"),
        ("is_foreign_location", "Foreign Location"),
        ("failed_logins_24h", "Multiple Failed Logins")]
    assert got[1] == [] and got[2] == []


def test_suspicious_vector_scores_above_normal(spark):
    scaler = [(0.1, 1.2), (0.2, 0.4), (0.02, 0.13), (0.01, 0.1), (0.01, 0.1), (0.15, 0.6),
              (0.1, 0.3), (0.1, 0.3), (106.0, 111.0), (3.0, 12.0)]
    model = L.fixed_transaction_model(scaler)
    rows = inputs(spark, [[8, 1, 1, 1, 1, 5, 1, 3, 450, 92], [0.1, 0, 0, 0, 0, 0, 0, 1, 100, 5]])
    explained = X.add_probability_contributions(rows, model, [[0.0] * 10]).select(
        model.served_probability().alias("p"),
        X.top_reasons(F.col("contributions")).alias("r")).collect()
    assert explained[0].p > 0.8 > 0.05 > explained[1].p
    assert len(explained[0].r) == 4


SCORES = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.8, 0), (0.9, 1), (0.5, 1), (0.3, 0)]


@pytest.mark.parametrize("max_rows", [None, 2])
def test_auc_equals_the_evaluator(spark, max_rows):
    rows = spark.createDataFrame(SCORES * 5, "p double, y int")
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0)
    want = evaluator.evaluate(rows.withColumn("y", F.col("y").cast("double")))
    assert E.auc_roc(rows, "p", "y", max_rows).first()[0] == round(want, 4)


def test_metrics_of_one_class_and_no_positives(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.2, 0)], "p double, y int")
    got = E.metrics(rows, "p", "y", "m").first()
    assert (got.precision, got.recall, got.f1_score, got.auc_roc) == (0.0, 0.0, 0.0, None)
    assert got.confusion_matrix.true_negative == 2


def test_threshold_is_inclusive(spark):
    rows = spark.createDataFrame([(0.5, 1), (0.49, 0)], "p double, y int")
    assert E.confusion(rows, "p", "y").first().asDict() == {
        "true_negative": 1, "false_positive": 0, "false_negative": 0, "true_positive": 1}


def test_trained_models_find_the_episodes(spark):
    trained = catalog.trained(spark, "/root/testdata/sf0.01")
    got = {r.model: r for r in trained.metrics().collect()}
    assert got["trajectory"].auc_roc > 0.8
    assert got["transaction"].auc_roc > 0.95
    assert got["transaction"].test_set_size == got["trajectory"].test_set_size


def test_regularisation_is_chosen_on_the_validation_part(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("transaction_id"),
        *[F.randn(seed=i).alias(c) for i, c in enumerate(C.MODEL_INPUTS)])
    rows = rows.withColumn("is_fraud", F.when(
        F.col("amount_zscore") + 0.3 * F.col("risk_score") > 1.5, 1).otherwise(0))
    weak = L.fit_transaction_model(rows, regs=(0.001,))
    chosen = L.fit_transaction_model(rows, regs=(1000.0, 0.001))
    assert chosen.weights == pytest.approx(weak.weights, rel=0.05, abs=0.05)


def test_quartiles_interpolate_and_may_be_cut(spark):
    values = [float(v * v % 37) for v in range(50)] + [None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").withColumn("y", F.lit(2))
    want = rows.select(F.percentile("x", [0.25, 0.5, 0.75])).first()[0]
    for max_rows in (None, 5):
        got = {r.feature: r for r in E.feature_summary(rows, ["x", "y"], max_rows).collect()}
        assert [got["x"].q25, got["x"].q50, got["x"].q75] == pytest.approx(want)
        assert (got["x"]["count"], got["y"]["q50"]) == (50, 2.0)


def test_metrics_table_is_kept_until_refresh(spark, tmp_path):
    path, calls = str(tmp_path / "metrics"), []

    def compute():
        calls.append(1)
        return spark.range(1).withColumn("n", F.lit(len(calls)))
    first = reports.stored_metrics(spark, path, compute).first().n
    second = reports.stored_metrics(spark, path, compute).first().n
    third = reports.stored_metrics(spark, path, compute, refresh=True).first().n
    assert (first, second, third) == (1, 1, 2)


def test_splits(spark):
    rows = spark.range(4000).select(F.col("id").alias("transaction_id"))
    share = L.add_split(rows).agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.17 < share < 0.23
    assert L.add_split(rows).exceptAll(L.add_split(rows.repartition(5))).count() == 0
    timed = spark.createDataFrame([("2024-01-01",), ("2024-01-03",)], "t string").select(
        F.col("t").cast("timestamp").alias("timestamp"))
    cut = F.to_timestamp(F.lit("2024-01-02"))
    assert [r.is_test for r in L.add_time_split(timed, cut).orderBy("timestamp").collect()] == [
        False, True]


def _inputs(spark, n):
    rows = spark.range(n).select(
        F.col("id").alias("transaction_id"),
        *[F.randn(seed=i).alias(c) for i, c in enumerate(C.MODEL_INPUTS)])
    near = (F.col("amount_zscore") > 0.5) & (F.col("risk_score") > 0)
    return rows.withColumn("is_fraud", F.when(near, 1).otherwise(0))


def test_coalitions_of_a_linear_score_are_its_terms(spark):
    rows, weights = _inputs(spark, 5), [0.5 * i - 2 for i in range(10)]
    background = [[float(i * j % 7) for i in range(10)] for j in range(6)]

    def score(table):
        return table.withColumn("score", sum(F.col(c) * w for c, w in zip(C.MODEL_INPUTS, weights)))

    got = {r.transaction_id: r.contributions for r in B.coalition_attribution(
        rows, "transaction_id", C.MODEL_INPUTS, score, background).collect()}
    means = [sum(b[i] for b in background) / 6 for i in range(10)]
    for r in rows.collect():
        assert got[r.transaction_id] == pytest.approx(
            [w * (r[c] - m) for c, w, m in zip(C.MODEL_INPUTS, weights, means)])


def test_boosted_reasons_of_all_rows_above_the_threshold(spark, small):
    model, background = catalog.boosted(spark, small)
    assert len(background) == C.BACKGROUND_ROWS
    score = model.probability(L.normalised_inputs(model.scaler))
    asked = {r.transaction_id for r in catalog.training_rows(spark, small).filter(
        score >= C.REASON_THRESHOLD).collect()}
    got = catalog.boosted_reasons(spark, small).select("transaction_id", "adds_up").collect()
    assert len(got) == len(asked) and {r.transaction_id for r in got} == asked
    assert all(r.adds_up for r in got)


def test_boosted_trees_find_an_interaction_and_its_reasons(spark):
    rows = _inputs(spark, 3000).cache()
    model = B.fit_boosted_model(rows.filter("transaction_id % 4 > 0"), max_iter=5)
    test = model.score(rows.filter("transaction_id % 4 = 0"))
    right = test.filter((F.col("score") >= 0.5) == (F.col("is_fraud") == 1)).count() / test.count()
    assert right > 0.95
    some = test.filter("is_fraud = 1").limit(5)
    background = [[float(v) for v in r] for r in rows.select(*C.MODEL_INPUTS).limit(8).collect()]
    raw = spark.createDataFrame(background, C.MODEL_INPUTS)
    mean = model.score(raw).agg(F.avg("score")).first()[0]
    found = B.coalition_attribution(some.drop("score"), "transaction_id", C.MODEL_INPUTS,
                                    model.score, background)
    for r in found.join(some, "transaction_id").collect():
        assert sum(r.contributions) == pytest.approx(r.score - mean, abs=1e-9)
        strongest = sorted(range(10), key=lambda i: -r.contributions[i])[:2]
        assert C.MODEL_INPUTS[strongest[0]] in ("amount_zscore", "risk_score")
