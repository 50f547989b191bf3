import io

import numpy as np
import pytest

from glyphloom import __main__ as command
from glyphloom.functions import lstm
from glyphloom.operators.guard import violations
from glyphloom.plans import experiment
from glyphloom.plans.training import load_checkpoint
from glyphloom.sources import vocab_json
from glyphloom.sources.sinks import Console

SMALL = experiment.Sizes(embed=6, hidden=8, layers=2, dropout=0.2, seq_len=8, batch=32, log_every=5)


def corpus(spark, rows):
    return spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id bigint, lang string, text string")


@pytest.mark.parametrize(
    ("field", "value"), [("lang", 3), ("from_checkpoint", 3), ("freeze_embed", "yes"), ("epochs", "3"), ("epochs", True), ("lr", 1)]
)
def test_requests_of_other_types_are_refused(field, value):
    with pytest.raises(TypeError, match=f"for {field}, got {type(value).__name__}"):
        experiment.checked(experiment.Request("tr")._replace(**{field: value}))
    assert experiment.checked(experiment.Request("tr", "a.pt", True, 2, 0.1)).epochs == 2


def test_names_and_versions(tmp_path):
    assert experiment.names(experiment.Request("tr"), "out/") == ("tr-train", "out/checkpoints/tr_best.pt", "out/checkpoints/vocab.json")
    assert experiment.names(experiment.Request("az", "checkpoints/tr_best.pt"), "out")[:2] == ("tr->az", "out/checkpoints/tr_to_az.pt")
    path = str(tmp_path / "m.pt")
    got = []
    for _ in range(3):
        got.append(experiment.free_version(path))
        (tmp_path / got[-1].rsplit("/", 1)[1]).mkdir()
    assert [p.rsplit("/", 1)[1] for p in got] == ["m.pt", "m.ft1.pt", "m.ft2.pt"]


def test_an_epoch_visits_every_window_once_and_flushes_figures():
    ids = np.arange(100) % 5
    samples = experiment.samples_of(ids, 8)
    state = experiment.State(lstm.init_params(5, 6, 8, 2), lstm.Adam(1e-2), step=3)
    after, loss, rows = experiment.train_epoch(samples, state, 1, SMALL, freeze=True)
    assert len(samples) == 92 and after.step == 3 + 3 and [r["global_step"] for r in rows] == [5, 6]
    assert rows[-1]["percent"] == 100 and 2 * rows[0]["loss"] + rows[1]["loss"] == pytest.approx(3 * loss)
    np.testing.assert_array_equal(after.params["embedding.weight"], state.params["embedding.weight"])
    assert not np.array_equal(after.params["fc.weight"], state.params["fc.weight"])
    assert experiment.mean_loss(after.params, samples[:0], 32) == (0.0, 1.0)


def test_a_run_trains_and_another_fine_tunes_it(spark, tmp_path):
    docs = corpus(spark, [("tr", "abcd" * 120), ("az", "abdx" * 100), ("tr", "abcd" * 30)])
    said = io.StringIO()
    first = experiment.run(docs, experiment.Request("tr", epochs=2, lr=5e-2), str(tmp_path), SMALL, Console(said))
    assert first.names.run == "tr-train" and first.checkpoint.endswith("checkpoints/tr_best.pt")
    ids, _, size, unk = vocab_json.load(first.names.vocabulary)
    assert list(ids) == ["a", "b", "c", "d", unk] and size == 5
    assert first.history[0]["val_loss"] < np.log(5) and first.test_ppl == pytest.approx(np.exp(first.test_loss))
    assert first.history[-1]["best_val_loss"] == min(h["val_loss"] for h in first.history)
    assert "Saved best model" in said.getvalue() and said.getvalue().endswith("Done!\n")

    tuned = experiment.Request("az", first.checkpoint, freeze_embed=True, epochs=1, lr=1e-2)
    second = experiment.run(docs, tuned, str(tmp_path), SMALL, Console(None))
    assert vocab_json.load(first.names.vocabulary)[2] == 5  # x has the unknown token's id
    assert second.history[0]["learning_rate"] == 5e-5
    old, new = load_checkpoint(spark, first.checkpoint), load_checkpoint(spark, second.checkpoint)
    np.testing.assert_array_equal(old["embedding.weight"], new["embedding.weight"])
    assert not np.array_equal(old["fc.weight"], new["fc.weight"])
    assert experiment.run(docs, tuned, str(tmp_path), SMALL, Console(None)).checkpoint.endswith("tr_to_az.ft1.pt")

    metrics = spark.read.parquet(f"{tmp_path}/metrics").collect()
    assert {(r["run"], r["kind"]) for r in metrics} == {(run, kind) for run in ("tr-train", "tr->az") for kind in ("train", "val", "test")}
    assert [r["epochs_no_improve"] for r in metrics if r["run"] == "tr-train" and r["kind"] == "val"][0] == 0
    settings = {r["name"]: r["value"] for r in spark.read.parquet(f"{tmp_path}/settings").where("run = 'tr->az'").collect()}
    assert settings["effective_lr"] == "5e-05" and settings["vocab_size"] == "5"


def test_a_run_that_cannot_begin(spark, tmp_path):
    docs = corpus(spark, [("tr", "abcd" * 30)])
    with pytest.raises(FileNotFoundError, match="Checkpoint not found"):
        experiment.run(docs, experiment.Request("tr", str(tmp_path / "none.pt")), str(tmp_path), SMALL, Console(None))
    empty = experiment.run(docs, experiment.Request("az", epochs=1), str(tmp_path / "other"), SMALL, Console(None))
    assert (empty.test_loss, empty.test_ppl) == (0.0, 1.0)


def test_command_line(spark, tmp_path, capsys):
    asked = command.parser().parse_args(["train", "--data", "d", "--lang", "tr", "--from-checkpoint", "x.pt", "--freeze-embed"])
    assert (asked.lang, asked.from_checkpoint, asked.freeze_embed, asked.epochs, asked.lr, asked.out) == ("tr", "x.pt", True, 3, 1e-4, ".")
    for words in (["train", "--data", "d"], ["query", "none", "--data", "d"], []):
        with pytest.raises(SystemExit) as left:
            command.parser().parse_args(words)
        assert left.value.code == 2
    corpus(spark, [("tr", "abcd" * 30)]).write.parquet(str(tmp_path / "documents.parquet"))
    with pytest.raises(SystemExit) as left:
        command.main(["train", "--data", str(tmp_path), "--lang", "xx"])
    assert left.value.code == 2 and "choose from tr" in capsys.readouterr().err
    assert command.main(["query", "corpus_stats", "--data", str(tmp_path)]) == 0
    assert "tr" in capsys.readouterr().out
    assert command.main(["guard", str(tmp_path)]) == 1


def test_a_rule_of_ones_own(spark):
    def todo(source):
        yield from ((i, "todo", line) for i, line in enumerate(source.text.split("\n"), 1) if "TODO" in line)

    rows = spark.createDataFrame([("src/a.py", "x = 1\ny = 2  # TODO\n"), ("src/b.py", "print(1)\n")], "path string, source string")
    got = {(r["path"], r["rule"], r["line_no"]) for r in violations(rows, {"todo": todo}).collect()}
    assert got == {("src/a.py", "todo", 2), ("src/b.py", "logging", 1)}
