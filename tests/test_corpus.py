import math

import numpy as np
import pytest

from glyphloom.operators import corpus
from glyphloom.operators.evaluation import bigram_losses, transfer_matrix
from glyphloom.sources.tables import corpus_files, manifest


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, lang string, text string")


def vocab_of(spark, text, unk=corpus.UNK):
    rows = corpus.vocabulary(docs(spark, [(1, "x", text)]), unk=unk).collect()
    return [r["ch"] for r in sorted(rows, key=lambda r: r["id"])]


@pytest.mark.parametrize(
    "text, unk, expected",
    [("hello", "<unk>", ["e", "h", "l", "o", "<unk>"]), ("cba", "<unk>", ["a", "b", "c", "<unk>"]), ("abc", "[UNK]", ["a", "b", "c", "[UNK]"]),
     ("abc*def", "*", ["a", "b", "c", "d", "e", "f", "*"]), ("aé😀", "<unk>", ["a", "é", "😀", "<unk>"])],
)
def test_vocabulary_is_sorted_by_code_point_with_unknown_last(spark, text, unk, expected):
    assert vocab_of(spark, text, unk) == expected


def test_encode_maps_unknown_characters_to_the_last_id():
    assert corpus.encode("axb", "abc").tolist() == [0, 3, 1]
    assert corpus.encode("xyz", "abc").tolist() == [3, 3, 3]
    assert corpus.encode("", "abc").tolist() == []


def test_split_of_1000_characters(spark):
    rows = {r["split"]: r["n_chars"] for r in corpus.split_sizes(docs(spark, [(1, "x", "a" * 600), (2, "x", "a" * 400)])).collect()}
    assert rows == {"train": 700, "val": 150, "test": 150}
    parts = {r["split"]: r["n_chars"] for r in corpus.corpus_split(docs(spark, [(1, "x", "a" * 600), (2, "x", "a" * 400)])).collect()}
    assert parts == rows


def test_lengths_and_batches(spark):
    table = docs(spark, [(1, "x", "abcdefghij" * 1000)])
    plan = {(r["split"], r["batch_size"]): (r["samples"], r["batches"]) for r in corpus.batch_plan(table).collect()}
    assert plan["train", 64] == (6900, 108)
    assert plan["val", 64] == plan["test", 64] == (1400, 22)


def test_cap_cuts_the_last_document(spark):
    rows = corpus.positioned(docs(spark, [(5, "x", "abc"), (2, "x", "de"), (9, "x", "fg")]), max_chars=4).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["off"], r["n"]) for r in rows] == [(2, "de", 0, 4), (5, "ab", 2, 4)]


@pytest.mark.parametrize("seq_len", [1, 3, 5])
def test_windows_equal_slices(spark, seq_len):
    rng = np.random.default_rng(seq_len)
    rows = [(int(i), "xy"[i % 2], "".join(rng.choice(list("abcdé\n"), size=int(rng.integers(0, 40))))) for i in rng.permutation(30)]
    table = docs(spark, rows)
    got = {(r["lang"], r["split"], r["i"]): (r["x"], r["y"]) for r in corpus.windows(table, seq_len, batch=2).collect()}
    expected = {}
    for lang in "xy":
        text = "".join(t for _, own, t in sorted(rows) if own == lang)
        ids = [sorted(set(text)).index(c) for c in text]
        a, b = int(len(ids) * 0.7), int(len(ids) * (0.7 + 0.15))
        for split, part in (("train", ids[:a]), ("val", ids[a:b]), ("test", ids[b:])):
            for i in range(max(0, len(part) - seq_len)):
                expected[lang, split, i] = (part[i : i + seq_len], part[i + 1 : i + seq_len + 1])
    assert got == expected


def test_evaluation_is_the_mean_of_batch_means(spark):
    text = "abcab" * 39
    row = transfer_matrix(docs(spark, [(1, "x", text)]), seq_len=4, batch=8).first()
    alphabet, n = "abc", len(text)
    ids = corpus.encode(text, alphabet)
    train, test = ids[: int(n * 0.7)], ids[int(n * (0.7 + 0.15)) :]
    keys, counts = np.unique(train[:-1] * 4 + train[1:], return_counts=True)
    losses = bigram_losses(test, 4, keys, counts)
    means = [losses[i : i + 4].mean() for i in range(len(test) - 4)]
    batches = [np.mean(means[i : i + 8]) for i in range(0, len(means), 8)]
    assert len(means) % 8
    assert row["loss"] == pytest.approx(np.mean(batches), abs=1e-6)
    assert row["ppl"] == pytest.approx(math.exp(np.mean(batches)), abs=1e-5)


def test_text_files_get_line_feeds(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"a\r\nb\rc")
    assert corpus_files(spark, {"x": str(tmp_path / "x.txt")}).first()["text"] == "a\nb\nc"


def test_manifest_rows(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"generated_at": "t",\n "results": {"tr": {"ipa_characters": 5, "lines_written": 2, "output_file": "f"}}}')
    assert [tuple(r) for r in manifest(spark, str(tmp_path / "m.json")).collect()] == [("tr", 5, 2, "f")]


def test_ranges_past_the_cap_are_left_out_before_rows_move(spark):
    rows = [(i * 3000, "en", "x" * (i % 7)) for i in range(60)] + [(5, "fr", ""), (9000, "fr", "abc"), (1, "de", "long" * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    for most in (1, 20, 100, 10_000):
        off, wanted = {}, []
        total = {lang: sum(len(t) for _, x, t in rows if x == lang) for lang in ("en", "fr", "de")}
        for i, lang, text in sorted(rows):
            at = off.get(lang, 0)
            off[lang] = at + len(text)
            if text and at < most:
                wanted.append((i, lang, text[: most - at], at, min(len(text), most - at), min(total[lang], most)))
        assert sorted(map(tuple, corpus.positioned(docs, most).collect())) == sorted(wanted)
