import os
import random
import re

import numpy as np
import pytest

from glyphloom.llm import op7_heavy_light as join
from glyphloom.llm import op10_line_join as lines
from glyphloom.llm import words
from glyphloom.llm.common import RELEASED, Scratch, forget, kept, scratch_dir, settings, thrifty
from glyphloom.llm.components import components


def shingles(text):
    own = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(own[i : i + 5]) for i in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])


def linked(rows, percent=80):
    known = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in known if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in known:
        for b, y in known:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in known), key=repr)


def test_word_hashes_follow_the_contract():
    text = "One two\tTHREE\x0bfour\x0cfive  six\x1cx é"
    own = words.of_text(text)
    assert [bytes(own.raw[a:b]).lower() for a, b in zip(own.at, own.to)] == re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    assert len(set(own.hashes.tolist())) == len(own.hashes)
    assert words.of_text("ONE").hashes.tolist() == words.of_text("one").hashes.tolist()
    assert words.of_text(None).hashes.tolist() == []


def test_join_equals_brute_force(spark, docs, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in join.linked(docs).collect()), key=repr)
    assert got == linked(docs.collect())
    assert join.linked(none).count() == 0


def test_join_with_light_sets_and_long_lists(spark, monkeypatch):
    """Sets of a few shingles, and groups of near copies in long lists, at limits that use every branch."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    base = [f"v{i}" for i in range(60)]
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(60)] = f"z{rng.randrange(999)}"
        texts.append(" ".join(own))
    monkeypatch.setattr(join, "LONG", 3)
    monkeypatch.setattr(join, "FREQUENT", 4)
    monkeypatch.setattr(join, "SAMPLED", 2)
    monkeypatch.setattr(join, "BROADCAST_IDS", 10)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in join.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == linked(rows)


def test_rows_that_share_an_id_are_one_document(spark):
    one, two = ("a b c d e f g h i j k l", "m n o p q r s t u v w x")
    rows = [(5, one), (5, two), (3, one), (9, two), (9, two), (9, two + " y"), (4, None), (4, "z"), (None, one), (None, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in join.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == linked(rows)


def test_sketches_never_lose_a_shingle():
    rng = np.random.default_rng(3)
    for n, m, shared in ((3, 5, 2), (40, 44, 30), (900, 30, 20), (5000, 5200, 4800), (0, 4, 0)):
        both = rng.integers(0, 1 << 64, shared, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 64, k - shared, dtype=np.uint64)])) for k in (n, m))
        most = join.most_common(join.sketch(x), join.sketch(y))
        assert len(np.intersect1d(x, y)) <= most <= min(n, m)
    assert join.most_common(join.sketch(np.zeros(300, np.uint64)), join.sketch(both)) is None


def test_parities_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(6)
    for n, m, shared in ((3, 5, 2), (40, 44, 30), (900, 30, 20), (5000, 5200, 4800), (400, 400, 0)):
        both = rng.integers(0, 1 << 64, shared, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 64, k - shared, dtype=np.uint64)])) for k in (n, m))
        bits = sum(int(a ^ b).bit_count() for a, b in zip(*(join.parities(v).view(np.uint64) for v in (x, y))))
        assert bits <= len(np.setxor1d(x, y)) and (n, m) != (400, 400) or bits > 88
    assert not join.parities(np.zeros(0, np.uint64)).any() and len(join.parities(x)) * 64 == join.PARITIES


def test_members_of_a_long_list_that_cannot_link_make_no_pairs(spark):
    """Of a list with 60 members of 60 components only the two that link are paired, not all 1,770 pairs."""
    rng = np.random.default_rng(9)
    sets = [rng.integers(0, 1 << 64, 200, dtype=np.uint64) for _ in range(59)]
    sets.append(np.concatenate([sets[0][:195], sets[1][:5]]))
    placed = spark.createDataFrame([(1, i, 200, 40, 1, 40, i) for i in range(60)], "shingle bigint, node bigint, n int, e bigint, r int, l bigint, comp bigint")
    held = spark.createDataFrame([(i, join.parities(x).tolist()) for i, x in enumerate(sets)], "node bigint, odd array<bigint>")
    with Scratch(spark) as own:
        assert [tuple(r) for r in join._across(placed, held, 12, 80, own).collect()] == [(0, 59)]


def test_shingles_that_crowd_prefixes_come_last(spark, monkeypatch):
    """A phrase of five words is too short to be found as a passage; documents have enough others for their prefixes."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.sample([f"u{i}x{k}" for k in range(60)] + ["one two three four five"] * 1, 61))) for i in range(100)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(join, "DRAWN", 1)
    shared = next(join._sets(join.pa.array(["one two three four five"])))
    monkeypatch.setattr(join, "prefix_length", lambda n, percent=80: n - 1)  # else it seldom gets there
    with Scratch(spark) as own:
        late = np.zeros(0, np.uint64)
        plain, thin = (df.collect() for df in (join.prefixes(texts, late, 80), join.thinned(texts, late, 80, own)))
        in_prefix = [sum(int(shared[0]) in np.frombuffer(r["prefix"], np.uint64).tolist() for r in rows) for rows in (plain, thin)]
        assert in_prefix[0] > 80 and in_prefix[1] == 0
        assert sorted(r["node"] for r in thin) == list(range(100)) and {len(r["prefix"]) for r in thin} == {len(r["prefix"]) for r in plain}


def test_only_drawn_documents_are_shingled_twice_for_the_order(spark, monkeypatch):
    """Whatever shares of the documents get another prefix: here all have the phrase in theirs."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.sample([f"u{i}x{k}" for k in range(60)] + ["one two three four five"], 61))) for i in range(200)]
    read, plain = [], join.prefixes
    monkeypatch.setattr(join, "prefixes", lambda texts, *more: read.append(texts.count()) or plain(texts, *more))
    monkeypatch.setattr(join, "prefix_length", lambda n, percent=80: n - 1)
    with Scratch(spark) as own:
        assert join.thinned(spark.createDataFrame(rows, "doc_id bigint, text string"), np.zeros(0, np.uint64), 80, own).count() == 200
    assert 200 < sum(read) < 260


@pytest.mark.parametrize("size", [0, 1, 50, 40_000])
def test_members_are_told_exactly_and_few_others_are_searched(size):
    rng = np.random.default_rng(size)
    ends = np.array([0, (1 << 64) - 1], dtype=np.uint64)
    known = np.unique(np.concatenate([rng.integers(0, 1 << 64, size, dtype=np.uint64), ends[: min(size, 2)]]))
    others = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    asked = rng.permutation(np.concatenate([known, others, known + np.uint64(1), ends]))
    members = join.Members(known)
    assert np.array_equal(members.of(asked), np.isin(asked, known))
    assert len(members.likely(others)) < len(others) / 8 and not len(members.of(others[:0]))


def test_workers_give_unused_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr("glyphloom.llm.common.give_back", lambda: calls.append(1))
    assert list(thrifty(lambda batches: (2 * x for x in batches))(iter(range(2 * RELEASED + 1)))) == [2 * x for x in range(2 * RELEASED + 1)]
    assert len(calls) == 3


def test_only_what_the_result_reads_is_left(spark, docs):
    def tables():
        where = scratch_dir(spark).removeprefix("file://").removeprefix("file:")
        return set(os.listdir(where)) if os.path.isdir(where) else set()

    before, held = tables(), kept()
    out = join.linked(docs)
    left = tables() - before
    assert len(left) == len(kept() - held) == 1 and out.count() == docs.count()
    forget(kept() - held)
    assert tables() == before


def test_light_subsets_cost_less_than_lists_only_while_small():
    assert join.subset_keys(1, 12) == 1
    assert join.subset_keys(12, 12) > join.prefix_length(12)
    assert join.light_boundary({}, 3.0, 80) >= 1
    assert join.light_boundary({12: 1000}, 0.0, 80) < 12


def test_components_of_a_long_chain(spark):
    n = 40
    rows = [(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)]
    with Scratch(spark) as own:
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "a bigint, b bigint"), own).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def surviving(rows):
    """Brute force: a line goes if any earlier one has a Jaccard similarity of 0.8 or more."""
    unique = {}
    for i, t, *_ in rows:
        if t is not None:
            unique.setdefault((i is not None, i, t), [shingle_line(x) for x in t.split("\n")])
    order = sorted(unique, key=lambda k: (k[0], k[1] or 0))
    assert len({k[:2] for k in order}) == len(order)
    seen, out = [], {}
    for key in order:
        kept = []
        for text, own in zip(key[2].split("\n"), unique[key]):
            if own and any(100 * len(own & s) >= 80 * len(own | s) for s in seen):
                pass
            else:
                kept.append(text)
            seen += [own] if own else []
        out[key[1], key[2]] = "\n".join(kept)
    return out


def shingle_line(line):
    own = [w for w in re.split("[ \t\r\x0b\x0c]+", line.lower()) if w]
    return frozenset(tuple(own[i : i + 5]) for i in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])


@pytest.mark.parametrize("frequent", [24, 3])
def test_line_dedup_equals_brute_force(spark, docs, none, monkeypatch, frequent):
    monkeypatch.setattr(lines, "FREQUENT", frequent)
    out = lines.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "rank", "n_lines", "n_removed"]
    expected = surviving(docs.collect())
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    wanted = sorted([(i, None if t is None else expected[i, t]) for i, t, *_ in docs.collect()], key=repr)
    assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=repr) == wanted
    assert len(texts) and lines.dedup_lines(none).count() == 0


def test_many_removed_lines_of_few_documents_move_no_texts(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 10)
    rows = [(i, "\n".join(["the same line of some words"] * 20 + [f"line {i} has {i} words of its own"])) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        out = lines.dedup_lines(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    own = [t.split("\n")[-1] for _, t in rows]
    assert got == {0: (f"the same line of some words\n{own[0]}", 21, 19)} | {i: (own[i], 21, 20) for i in range(1, 5)}


def test_lists_send_few_values_of_a_class_to_every_executor(spark, monkeypatch):
    """Sizes, places and numbers of entries of the classes in lists go by shuffle; what each executor gets is their keys."""
    rng = random.Random(4)
    rows = [[f"q{i}x{k}" for k in range(30)] for i in range(100)]
    rows += [[*own[:20], *(f"z{rng.randrange(10**9)}" for _ in range(10))] for own in rows]
    docs = spark.createDataFrame([(i, " ".join(own)) for i, own in enumerate(rows)], "doc_id bigint, text string")
    sent, small = [], Scratch.small

    def spied(own, df, *columns, **more):
        sent.append(own.seen(df)["rows"] * len((df.select(*columns) if columns else df).columns))
        return small(own, df, *columns, **more)

    monkeypatch.setattr(Scratch, "small", spied)
    with Scratch(spark) as own:
        members, firsts = lines._members(docs, 80, own)
        lists = lines._lists(docs, members, firsts, 80, own)
        got = {(r["cls"], r["token"]): r for r in lists.collect()}
        places = {r["cls"]: (r["first"], r["n"]) for r in firsts.collect()}
    classes = {cls for cls, _ in got}
    assert len(classes) > 100 and sum(sent) <= 2 * len(classes)
    for (cls, _), r in got.items():
        assert (r["first"], r["n"]) == places[cls] and r["e"] == sum(c == cls for c, _ in got)
