"""Portable trees: the library's values, attribution by all coalitions, and every scoring job."""

import itertools
import math
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendtrace import contract as C
from spendtrace.operators import boosted as BT
from spendtrace.operators import learn as L
from spendtrace.operators import snapshot as SN
from spendtrace.operators import stored
from spendtrace.operators import trajectory as TJ
from spendtrace.operators import trees as TR
from spendtrace.operators.explain import add_probability_contributions
from spendtrace.plans import scoring
from spendtrace.sources import writers
from spendtrace.streaming import behaviour as B
from spendtrace.streaming import sinks
from tests.helpers import START, close, random_log
from tests.test_scoring import MODELS, SCALER, log_of, values


def random_trees(rng, count=6, depth=4):
    trees = []
    for _ in range(count):
        nodes, waiting = [[]], [(0, 0)]
        for at, level in waiting:
            if level == depth or (level and rng.random() < 0.2):
                nodes[at] = [float(rng.normal())]
            else:  # few inputs, so that one comes twice on a way
                nodes[at] = [int(rng.integers(0, 5)), round(float(rng.normal()), 1), len(nodes), len(nodes) + 1]
                waiting += [(len(nodes), level + 1), (len(nodes) + 1, level + 1)]
                nodes += [[], []]
        trees.append(nodes)
    return TR.TreeModel(0.3, trees)


def by_coalitions(value, x, b):
    n, out = len(x), np.zeros(len(x))
    cache = {s: value(np.where([s >> i & 1 for i in range(n)], x, b)) for s in range(1 << n)}
    for i, s in itertools.product(range(n), range(1 << n)):
        if not s >> i & 1:
            k = s.bit_count()
            out[i] += (cache[s | 1 << i] - cache[s]) * math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n)
    return out


def test_attribution_equals_all_coalitions():
    rng = np.random.default_rng(4)
    model = random_trees(rng)
    x, background = rng.normal(size=(3, 10)).round(1), rng.normal(size=(4, 10)).round(1)
    background[0] = x[0]
    got = TR.tree_contributions(model, x, background)
    for row, found in zip(x, got):
        want = np.mean([by_coalitions(model.background_value, row, b) for b in background], axis=0)
        assert np.abs(found - want).max() < 1e-9
        assert found.sum() == pytest.approx(model.background_value(row) - model.logits(background).mean(), abs=1e-9)
        assert np.all(found[5:] == 0)


def frame(spark, vectors):
    rows = [(f"t{i}", *[None if v is None else float(v) for v in row]) for i, row in enumerate(vectors)]
    return spark.createDataFrame(rows, "transaction_id string, " + ", ".join(f"{c} double" for c in C.MODEL_INPUTS))


def test_columns_and_probability_contributions(spark):
    rng = np.random.default_rng(5)
    model = random_trees(rng)
    x, background = rng.normal(size=(20, 10)).round(1), rng.normal(size=(6, 10)).round(1)
    rows = frame(spark, [*x, [None] * 10])
    got = add_probability_contributions(rows, model, background.tolist()).withColumn(
        "p", model.probability(L.normalised_inputs(model.scaler))).orderBy(F.length("transaction_id"), "transaction_id").collect()
    base = (1 / (1 + np.exp(-model.logits(background)))).mean()
    for r, row in zip(got, x):
        p = 1 / (1 + math.exp(-model.background_value(row)))
        assert r.p == pytest.approx(p, abs=1e-12)
        assert sum(r.contributions) == pytest.approx(p - base, abs=1e-9)
    assert got[20].contributions is None and got[20].p is not None


def test_portable_form_has_the_librarys_values(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 10))
    label = F.when((F.col("amount_zscore") > 0.3) & (F.col("risk_score") > -0.2), 1).otherwise(0)
    rows = frame(spark, x).withColumn("is_fraud", label)
    fitted = BT.fit_boosted_model(rows, max_iter=4, depth=3)
    model = fitted.portable()
    both = fitted.score(rows).withColumn("own", model.probability(L.normalised_inputs(model.scaler, None)))
    assert both.filter(F.abs(F.col("score") - F.col("own")) > 1e-9).count() == 0
    assert len(model.trees) == len(fitted.trees.trees)


TREES = L.RiskModels(TJ.fixed_trajectory_trees(), TR.fixed_tree_model(SCALER), MODELS.background)


def test_stored_trees_in_every_scoring_job(spark, tmp_path):
    writers.save_models(spark, TREES, str(tmp_path / "models"))
    models = writers.load_models(spark, str(tmp_path / "models"))
    assert isinstance(models.transaction, TR.TreeModel) and models == TREES
    assert isinstance(stored.from_json(stored.to_json(MODELS)).transaction, L.TransactionModel)
    rows = random_log(customers=3, rows=24)
    log, cut = log_of(spark, rows), START + timedelta(days=1)
    late = F.col("timestamp") >= F.lit(cut)
    scored = scoring.score_log(log, models)
    want = values(scored)
    assert any(r.reasons for r in scored.collect())
    assert want != values(scoring.score_log(log, MODELS, with_reasons=False))
    snapshot = SN.snapshot_of(scoring.behaviour(log.filter(~late)).rows())
    got = values(scoring.score_batch(log.filter(~late), log.filter(late).drop("is_fraud"), models, snapshot=snapshot))
    assert got and all(close(v, want[k], 1e-6) for k, v in got.items())
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    log.write.parquet(folder)
    sinks.write_scored(B.score_stream(sinks.read_transactions(spark, folder, log.schema), models), out,
                       str(tmp_path / "check")).awaitTermination()
    got = values(writers.read_scored(spark, out))
    assert got.keys() == want.keys() and all(close(got[k], want[k], 1e-6) for k in want)


def plain_value(tree, x, at=0):
    node = tree[at]
    return node[0] if len(node) == 1 else plain_value(tree, x, int(node[2] if x[int(node[0])] <= node[1] else node[3]))


def windows(spark, n=1200):
    """Fraud follows a foreign place in the last step together with logins in the one before."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        seq = rng.normal(size=(10, 9)).round(2)
        fraud = int(seq[9, 4] > 0.4 and seq[8, 5] > 0.1) if rng.random() < 0.95 else int(rng.random() < 0.5)
        rows.append((f"t{i}", seq.tolist(), fraud))
    return spark.createDataFrame(rows, "transaction_id string, seq array<array<double>>, label int")


def test_trees_grow_while_the_validation_part_gets_better(spark):
    table = windows(spark).cache()
    grown = TJ.grow_trajectory_trees(table, max_steps=12, depth=2)
    aucs = dict(grown.curve)
    assert list(aucs) == list(range(1, 13)) and len(grown.model.trees) == grown.chosen
    watched = {k: v for k, v in aucs.items() if k <= grown.stopped}
    assert aucs[grown.chosen] == max(watched.values()) > 0.85
    assert all(aucs[k] < aucs[grown.chosen] for k in range(1, grown.chosen))
    held = table.filter(L.hash_bucket("transaction_id", 1 << 20) % 100 < C.VALIDATION_PERCENT).collect()
    scores = [sum(plain_value(t, sum(r.seq, [])) for t in grown.model.trees) for r in held]
    pairs = [(a > b) + 0.5 * (a == b) for a, r in zip(scores, held) if r.label for b, q in zip(scores, held) if not q.label]
    assert aucs[grown.chosen] == pytest.approx(np.mean(pairs), abs=1e-9)
    got = {r.transaction_id: r.p for r in table.select("transaction_id", grown.model.probability(F.col("seq")).alias("p")).collect()}
    assert all(got[r.transaction_id] == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-9) for r, s in zip(held, scores))


def test_step_that_is_kept():
    assert TJ.best_step([(1, 0.6), (2, 0.7), (3, 0.69), (4, 0.7)]) == (2, 4)
    assert TJ.best_step([(i, 1 - i / 100) for i in range(1, 20)]) == (1, 6)
    assert TJ.best_step([(1, 0.5), (2, 0.4), (3, 0.4), (4, 0.9)], patience=2) == (1, 3)


def test_one_class_keeps_all_trees(spark):
    table = windows(spark, 60).withColumn("label", F.when(F.col("transaction_id") == "t1", 1).otherwise(0))
    assert TJ.grow_trajectory_trees(table, max_steps=2, depth=1).chosen == 2
