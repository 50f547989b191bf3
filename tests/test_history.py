import math

import pytest
from pyspark.sql import functions as F

from glyphloom.operators import history, runs
from glyphloom.sources import vocab_json

INF = float("inf")
NAN = float("nan")
SEQUENCES = [[3.0, 2.0, 2.0, 1.0, 5.0], [INF, 1.0], [NAN, 1.0, 1.0, 0.5], [1.0, 2.0, 3.0, 0.1], [5.0, 4.0, 3.0]]


def fold(losses, patience):
    best, idle, rows = INF, 0, []
    for epoch, loss in enumerate(losses, 1):
        before = idle
        if loss < best:
            best, idle = loss, 0
        else:
            idle += 1
        rows.append((epoch, best, idle, before))
        if idle >= patience:
            break
    return rows


@pytest.mark.parametrize("patience", [1, 2, 3])
def test_epoch_fold_equals_a_loop(spark, patience):
    rows = [(str(k), e, v) for k, losses in enumerate(SEQUENCES) for e, v in enumerate(losses, 1)]
    table = spark.createDataFrame(rows, "run string, epoch int, val_loss double")
    got = history.folded(table, patience).where("ran").orderBy("run", "epoch").collect()
    expected = [(str(k), *r) for k, losses in enumerate(SEQUENCES) for r in fold(losses, patience)]
    assert [(r["run"], r["epoch"], r["best_val_loss"], r["epochs_no_improve"], r["no_improve_before"]) for r in got] == expected


def test_flush_windows_equal_a_loop(spark):
    steps = [(1 + (i // 250), i + 1, (i * 37 % 11) / 7) for i in range(620)]
    table = spark.createDataFrame([("r", e, s, v, float(s)) for e, s, v in steps], "run string, epoch int, step bigint, loss double, grad_norm double")
    expected, window = [], []
    for k, (epoch, step, loss) in enumerate(steps):
        window.append(loss)
        if step % 100 == 0 or k + 1 == len(steps) or steps[k + 1][0] != epoch:
            expected.append((epoch, step, len(window), round(sum(window) / len(window), 6), float(step)))
            window = []
    got = history.train_loss_windows(table).orderBy("global_step").collect()
    assert [(r["epoch"], r["global_step"], r["n_steps"], r["train_loss"], r["grad_norm"]) for r in got] == expected


def test_gradient_norm_skips_frozen_groups(spark):
    table = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [0.0]), ("b", None), ("c", [12.0])], "p string, g array<double>")
    rows = {r["param"]: r for r in history.grad_norm(table, "p", "g").collect()}
    assert rows["a"]["param_norm"] == 5 and rows["c"]["total_norm"] == 13 and rows["b"]["param_norm"] is None
    assert rows["a"]["clip_factor"] == pytest.approx(1 / 13, abs=1e-6)


def test_run_names(spark):
    table = spark.createDataFrame([(0, "tr", None, False), (1, "az", "checkpoints/tr_best.pt", True), (2, "az", "c/tr_to_az.ft1.pt", False)], "run_no int, lang string, from_checkpoint string, freeze_embed boolean")
    rows = {r["run_no"]: r for r in runs.run_registry(table).collect()}
    assert (rows[0]["run_name"], rows[0]["checkpoint_path"], rows[0]["effective_lr"]) == ("tr-train", "checkpoints/tr_best.pt", 1e-4)
    assert (rows[1]["run_name"], rows[1]["checkpoint_path"], rows[1]["effective_lr"]) == ("tr->az", "checkpoints/tr_to_az.pt", 5e-5)
    assert rows[2]["run_name"] == "tr_to_az.ft1->az"


@pytest.mark.parametrize(
    "existing, expected",
    [([], "model.pt"), (["model.pt"], "model.ft1.pt"), (["model.pt", "model.ft1.pt", "model.ft2.pt"], "model.ft3.pt"),
     ([f"model{x}.pt" for x in ("", ".ft1", ".ft2", ".ft3", ".ft4")], "model.ft5.pt"), (["model.pt", "model.ft2.pt"], "model.ft1.pt")],
)
def test_next_version_is_the_first_gap(spark, existing, expected):
    have = spark.createDataFrame([(p,) for p in existing], "path string")
    assert runs.next_version(spark.createDataFrame([("model.pt",)], "base string"), have).first()["path"] == expected


def test_versions_of_names_with_and_without_folder_and_suffix(spark):
    have = spark.createDataFrame([(p,) for p in ("a/m.pt", "a/m.ft1.pt", "m.ft1.pt", "n", "n.ft1", "n.ft02", "n.ft3", "b/m.pt", "b/m.pt", "b/m.ft99999999999999999999.pt")], "path string")
    bases = spark.createDataFrame([(p,) for p in ("a/m.pt", "m.pt", "m.ft1.pt", "n", "b/m.pt", "n")], "base string")
    got = {r["base"]: r["path"] for r in runs.next_version(bases, have).collect()}
    assert got == {"a/m.pt": "a/m.ft2.pt", "m.pt": "m.pt", "m.ft1.pt": "m.ft1.ft1.pt", "n": "n.ft2", "b/m.pt": "b/m.ft1.pt"}


def test_vocabulary_file_round_trip(tmp_path):
    path = tmp_path / "a" / "b" / "vocab.json"
    vocab_json.save({0: "a", 1: "é", 2: "<unk>"}, path)
    assert vocab_json.load(path) == ({"a": 0, "é": 1, "<unk>": 2}, {0: "a", 1: "é", 2: "<unk>"}, 3, "<unk>")
    with pytest.raises(KeyError):
        vocab_json.save({0: "a", 2: "b"}, path)


@pytest.mark.parametrize(
    "data, error, message",
    [("x", TypeError, "Expected dict"), ({}, KeyError, "Missing required key 'itos'"), ({"itos": "ab"}, TypeError, "Expected list for 'itos'"),
     ({"itos": [123]}, TypeError, "Expected str at itos"), ({"itos": [], "unk": 123}, TypeError, "Expected str for 'unk'")],
)
def test_vocabulary_file_errors(data, error, message):
    with pytest.raises(error, match=message):
        vocab_json.decode(data)
    assert vocab_json.decode({"itos": ["a"]}) == (["a"], "<unk>")


def test_vocabulary_rows_keep_the_last_of_repeated_characters(spark):
    rows = spark.createDataFrame([("x", '{"itos": ["a", "b", "a"]}')], "lang string, json string")
    got = {(r["ch"], r["id"], r["vocab_size"], r["unk"]) for r in vocab_json.from_rows(rows).collect()}
    assert got == {("a", 2, 3, "<unk>"), ("b", 1, 3, "<unk>")}


def test_perplexity_is_exp_of_the_mean(spark):
    table = spark.range(1, 11).select(F.lit("r").alias("run"), F.lit(1).alias("epoch"), F.col("id").alias("step"), (F.col("id") / 10).alias("loss"), F.lit(1.0).alias("grad_norm"))
    row = history.epoch_summary(table).first()
    assert row["train_ppl"] == pytest.approx(math.exp(0.55), abs=1e-6)
