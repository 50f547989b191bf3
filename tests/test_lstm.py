import numpy as np
import pytest

from glyphloom.functions import lstm
from glyphloom.plans import training


@pytest.fixture
def small():
    params = lstm.init_params(7, embed=3, hidden=4, layers=2, seed=1)
    rng = np.random.default_rng(2)
    return params, rng.integers(0, 7, (3, 5)), rng.integers(0, 7, (3, 5))


def test_gradients_equal_finite_differences(small):
    params, x, y = small
    masks = lstm.dropout_masks(params, 3, 5, 0.3, np.random.default_rng(3))
    _, grads = lstm.loss_and_gradients(params, x, y, masks)
    rng = np.random.default_rng(4)
    for name, p in params.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape)
            sides = []
            for step in (1e-5, -1e-5):
                moved = {**params, name: p.copy()}
                moved[name][at] += step
                sides.append(lstm.cross_entropy(lstm.forward(moved, x, masks)[0], y)[0])
            assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)


def test_full_size_parameter_count():
    assert lstm.count_params(lstm.init_params(50)) == 385 * 50 + 921_600


def test_clipping_bounds_the_norm(small):
    params, x, y = small
    _, grads = lstm.loss_and_gradients(params, x, y)
    big = {n: g * 1e3 for n, g in grads.items()}
    assert lstm.gradient_norm(lstm.clipped(big)) == pytest.approx(1.0, abs=1e-4)
    assert lstm.gradient_norm(lstm.clipped({n: g * 1e-6 for n, g in grads.items()})) == pytest.approx(1e-6 * lstm.gradient_norm(grads))


def samples(spark, text, seq_len):
    ids = [sorted(set(text)).index(c) for c in text]
    rows = [(i, ids[i : i + seq_len], ids[i + 1 : i + seq_len + 1]) for i in range(len(ids) - seq_len)]
    return spark.createDataFrame(rows, "i bigint, x array<int>, y array<int>")


def test_distributed_step_equals_one_machine(spark):
    table = samples(spark, "abab" * 10 + "cdcd" * 10, 6).repartition(5)
    params = lstm.init_params(5, 4, 6, 1, seed=0)
    rows = table.collect()
    loss, grads = lstm.loss_and_gradients(params, np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]))
    got_loss, got = training.step_gradients(training.batched(table, 10**6), params)
    assert got_loss == pytest.approx(loss)
    for name in grads:
        np.testing.assert_allclose(got[name], grads[name], atol=1e-12)


def test_evaluation_weighs_a_short_batch_as_a_full_one(spark):
    table = samples(spark, "abcde" * 5, 5)
    params = lstm.init_params(6, 4, 6, 1, seed=0)
    loss, ppl = training.evaluate(training.batched(table, 8), params)
    rows = sorted(table.collect(), key=lambda r: r["i"])
    means = [lstm.cross_entropy(lstm.forward(params, np.array([r["x"] for r in part]))[0], np.array([r["y"] for r in part]))[0] for part in (rows[:8], rows[8:16], rows[16:])]
    assert len(rows) == 20 and loss == pytest.approx(np.mean(means)) and ppl == pytest.approx(np.exp(np.mean(means)))
    assert training.evaluate(training.batched(table.where("i < 0"), 8), params) == (0.0, 1.0)


def test_shuffled_batches_are_full_and_repeatable(spark):
    table = samples(spark, "abcde" * 30, 5)
    sizes = {r["batch_id"]: r["count"] for r in training.batched(table, 32, 7).groupBy("batch_id").count().collect()}
    assert sizes == {0: 32, 1: 32, 2: 32, 3: 32, 4: 17}
    order = [tuple(r) for r in training.batched(table, 32, 7).select("i", "batch_id").orderBy("i").collect()]
    assert order == [tuple(r) for r in training.batched(table.repartition(3), 32, 7).select("i", "batch_id").orderBy("i").collect()]
    assert [b for _, b in order] != sorted(b for _, b in order)


def test_training_learns_freezes_and_saves(spark, tmp_path):
    table = samples(spark, "abababab" * 12 + "cdcdcdcd" * 12, 8)
    config = training.Config(seq_len=8, batch=32, embed=6, hidden=8, epochs=2, steps_per_epoch=4, lr=5e-2)
    start = lstm.init_params(5, 6, 8, 1, seed=0)
    before, _ = training.evaluate(training.batched(table, 32), start)
    best, history = training.train(table, table, 5, config, start=start, freeze=True)
    after, _ = training.evaluate(training.batched(table, 32), best)
    assert after < before and history[0]["val_loss"] < before
    np.testing.assert_array_equal(best["embedding.weight"], start["embedding.weight"])
    path = str(tmp_path / "m")
    training.save_checkpoint(spark, best, path)
    loaded = training.load_checkpoint(spark, path, best)
    for name in best:
        np.testing.assert_allclose(loaded[name], best[name], rtol=1e-6)
    with pytest.raises(ValueError):
        training.load_checkpoint(spark, path, lstm.init_params(9, 6, 8, 1))
    with pytest.raises(FileNotFoundError):
        training.load_checkpoint(spark, str(tmp_path / "none"))


def test_whole_epochs_are_trained(monkeypatch):
    sizes = []
    own = lstm.loss_and_gradients
    monkeypatch.setattr(lstm, "loss_and_gradients", lambda p, x, y: (sizes.append(x.shape), own(p, x, y))[1])
    config = training.Config(seq_len=8, batch=32, embed=6, hidden=8, epochs=2, lr=5e-2)
    size, best, (test_loss, test_ppl), history = training.train_texts({"train": "abcde" * 40, "val": "abcde" * 6, "test": "abcdf" * 6}, config)
    assert size == 7 and sizes == ([(32, 8)] * 6) * 2  # 192 windows, in batches of 32
    assert [h["epoch"] for h in history] == [1, 2] and history[1]["train_loss"] < history[0]["train_loss"]
    assert test_ppl == pytest.approx(np.exp(test_loss)) and test_loss > history[1]["val_loss"] > 0
    assert training.train_texts({"train": "ab"}, config)[2] == (0.0, 1.0)


def test_every_language_is_trained_on_all_of_its_text(spark):
    texts = [(1, "ab" * 1600, "en"), (2, "cd" * 90 + "é", "en"), (3, "xyz" * 100, "es"), (4, "", "es"), (5, "kurz", "de")]
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in texts], "doc_id bigint, text string, lang string")
    rows = training.lstm_histories(docs, training.Config(seq_len=100, embed=8, hidden=16, epochs=1)).collect()
    assert {r["lang"]: r["vocab_size"] for r in rows} == {"en": 6, "es": 4, "de": 5}
    assert all(r["n_params"] == lstm.count_params(lstm.init_params(r["vocab_size"], 8, 16, 1)) for r in rows)
    assert all(r["train_loss"] > 0 for r in rows if r["lang"] != "de")
