import random
import string
import zlib
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from glyphloom.llm import op2_bin_completion as completion
from glyphloom.llm import op9_packed_ids as packed
from glyphloom.llm.word_ids import WordEncoder, vocabulary_path


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(vocabulary_path())
    own.encode_special_tokens = True
    return own


def test_word_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(0)
    parts = ["'s", "t", " ", "\n", "\t", "1", "é", "É", "re", "!", ",", ".", ", ", ". ", "AB", "中", "😀", "ẖ", "H̱", "́", "\x1c", "\xa0", "ΑΣ", "İ", "<|endoftext|>"]
    own = WordEncoder(vocabulary_path())
    for _ in range(150):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(8)]
        for text, ids in zip(texts, own.ids(texts)):
            assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_plain_words_are_encoded_without_the_normaliser(tokenizer):
    """Words of lower-case Latin letters, the bulk of new words, with or without points at the end, cost no normalising and no pattern, and get the same ids."""
    own = WordEncoder(vocabulary_path())
    letters = [c for c in map(chr, range(0x250)) if c.isalpha() and c.islower()]
    rng = random.Random(2)
    words = [*letters, *(f"a{c}b" for c in letters), *{"".join(rng.choices(letters, k=rng.randint(1, 20))) for _ in range(2000)}]
    points = string.punctuation.replace("'", "")
    words += [w + "".join(rng.choices(points, k=rng.randint(1, 4))) for w in words]
    own.tokenizer = None  # would fail if it were asked for one of them
    for word, ids in zip(words, own.ids(words)):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(word, add_special_tokens=False).ids, repr(word)


def fewest_bins(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= items[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - items[i]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(4))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    for _ in range(40):
        capacity = rng.choice([10, 30, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        counts = np.bincount(items, minlength=capacity + 1)
        plan = completion.bin_completion(counts, capacity)
        used = np.zeros(capacity + 1, dtype=int)
        for sizes, times in plan:
            assert sum(sizes) <= capacity
            np.add.at(used, list(sizes), times)
        assert (used == counts).all()
        assert completion.bins(plan) == fewest_bins(items, capacity)


def test_completion_beats_best_fit_somewhere():
    counts = np.bincount([6, 5, 5, 4, 3, 3, 2, 2], minlength=11)
    counts[[8, 7, 2, 1]] += 1
    assert completion.bins(completion.bin_completion(counts, 10)) <= completion.bins(completion.best_fit(counts, 10))


@pytest.mark.parametrize(
    "capacity, items",
    [(100, [13] * 4 + [17] * 4 + [20] * 4), (60, [8, 8, 9, 9, 9, 9, 12, 12, 12, 12, 18]), (30, [4] * 4 + [5] * 6 + [7] * 2), (30, [7, 7, 8, 8, 8, 8, 9, 9, 9, 14])],
)
def test_search_that_ends_is_optimal(capacity, items):
    counts = np.bincount(items, minlength=capacity + 1)
    assert completion.bins(completion.bin_completion(counts, capacity)) == fewest_bins(items, capacity)


def test_all_fillings_are_listed():
    counts = np.bincount([9, 7, 7, 5, 4, 3, 3, 3, 2], minlength=31)
    found = [x for x in completion._every(counts, 20, []) if x is not None]
    wanted = set()
    for n in range(1, 10):
        for x in combinations([9, 7, 7, 5, 4, 3, 3, 3, 2], n):
            left = counts - np.bincount(x, minlength=31)
            if sum(x) <= 20 and not left[: 20 - sum(x) + 1].any():
                wanted.add(x)
    assert len(found) == len(set(found)) and set(found) == wanted


@pytest.mark.parametrize("plan", [packed.best_fit_decreasing, completion.best_fit])
def test_best_fit_decreasing_equals_a_scan(plan):
    rng = random.Random(1)
    for _ in range(100):
        capacity = rng.choice([10, 37, 100])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 40))), reverse=True)
        rooms = []
        for size in items:
            fitting = [r for r in rooms if r >= size]
            if fitting:
                rooms.remove(min(fitting))
            rooms.append((min(fitting) if fitting else capacity) - size)
        got = [capacity - sum(c) for c, n in plan(np.bincount(items, minlength=capacity + 1), capacity) for _ in range(n)]
        if plan is packed.best_fit_decreasing:
            assert sorted(got) == sorted(rooms)
        assert sum(capacity - g for g in got) == sum(items)


def expected_pieces(rows, tokenizer, capacity):
    out = []
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            out.append((doc, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return sorted(out, key=repr)


def test_packed_pieces(spark, docs, none, tokenizer):
    got = completion.pack(docs, 256).toPandas()
    rows = [tuple(None if v != v else v for v in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(rows, key=repr) == [tuple(r) for r in expected_pieces(docs.collect(), tokenizer, 256)] or sorted(map(repr, [(r[0] if r[0] is None else int(r[0]), *map(int, r[1:])) for r in rows])) == sorted(map(repr, expected_pieces(docs.collect(), tokenizer, 256)))
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"].to_numpy() == own["length"].cumsum().shift(fill_value=0).to_numpy()).all() and own["length"].sum() <= 256
    assert completion.pack(none).count() == 0


def test_packed_matrices(spark, docs, none, tokenizer):
    rows = packed.packed_rows(docs, 128).collect()
    pieces = []
    for r in rows:
        assert len(r["input_ids"]) == len(r["position_ids"]) == 128 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        for doc, piece, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert r["position_ids"][a:b] == list(range(b - a))
            pieces.append((doc, piece, b - a, zlib.crc32(np.array(r["input_ids"][a:b], "<u4").tobytes())))
        assert set(r["input_ids"][r["n_tokens"] :]) <= {0}
    assert sorted(pieces, key=repr) == sorted([(d, k, n, c) for d, k, _, n, c in expected_pieces(docs.collect(), tokenizer, 128)], key=repr)
    digest = {r["sequence_id"]: r["input_ids_crc32"] for r in packed.packed_digests(docs, 128).collect()}
    assert len(digest) == len(rows)
    assert packed.packed_rows(none).count() == 0


def test_the_query_returns_id_matrices(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    packed.write_matrices(docs, str(tmp_path / "out"))
    for rows in (packed.op9_packed_ids(spark, str(tmp_path)).collect(), spark.read.parquet(str(tmp_path / "out")).collect()):
        assert sum(r["n_segments"] for r in rows) >= docs.count()
        for r in rows:
            assert len(r["input_ids"]) == len(r["position_ids"]) == packed.CAPACITY and r["cu_seqlens"][-1] == r["n_tokens"]
            for name in ("input_ids", "cu_seqlens", "position_ids"):
                assert r[f"{name}_crc32"] == zlib.crc32(np.array(r[name], "<u4").tobytes())


def test_workers_keep_no_encoder_after_their_task(spark, docs):
    def alive(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "WordEncoder" for x in gc.get_objects())])], ["n"])

    assert completion.cut(docs.repartition(8), vocabulary_path(), 256).count()
    seen = spark.range(0, 64, 1, 8).mapInArrow(alive, "n bigint").collect()
    assert seen and not any(r["n"] for r in seen)
