import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from glyphloom.llm import op1_ordinal as ordinal
from glyphloom.llm import op3_lpt_shards as lpt
from glyphloom.llm import op5_ogg as ogg
from glyphloom.llm import op6_monoid_bpe as bpe
from glyphloom.llm import op8_wrapper as wrapper
from glyphloom.llm import words


def test_bpe_equals_the_library_at_any_leaf():
    rng = random.Random(0)
    parts = ["'s", "t", " ", "  ", "\n", "\t", "1", "é", "re", "ll", "'re", "!", "?", "ab", "中", "😀", "\r\n", "_", "́", "²", "\xa0"]
    for leaf in (1, 3, 16):
        own = bpe.ByteBpe(bpe.ranks_path(), leaf=leaf)
        for _ in range(300):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))
            ids = own.encode(text)
            assert ids == own.coder.encode_ordinary(text), repr(text)
            assert own.decode(ids, leaf) == text.encode()


def test_bpe_join_is_associative():
    own = bpe.ByteBpe(bpe.ranks_path())
    a, b, c = "It's a sta", "rt, isn't it?  ", " Yes it is.\n"
    one, two, three = map(own.encode, (a, b, c))
    left = own.join(a + b, own.join(a, one, b, two), c, three)
    assert left == own.join(a, one, b + c, own.join(b, two, c, three)) == own.coder.encode_ordinary(a + b + c)


def test_bpe_table(docs, none):
    own = bpe.ByteBpe(bpe.ranks_path())
    rows = bpe.round_trip(docs).collect()
    wanted = []
    for i, t, *_ in docs.collect():
        ids = own.coder.encode_ordinary(t or "")
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(wanted, key=repr)
    assert bpe.round_trip(none).count() == 0


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_checksum():
    for data in (b"", b"a", bytes(range(256)) * 3):
        assert ogg.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("frames", [1, 2, 3, 170, 400])
def test_ogg_round_trip(frames):
    payload = np.random.default_rng(frames).integers(0, 256, frames * ogg.FRAME, dtype=np.uint8).tobytes()
    streams = ogg.read(ogg.write(payload))
    assert ogg.payload_of(streams)[0] == payload
    assert [s.granules[-1] for s in streams.values()] == [-(-frames // 2) * ogg.FRAME, frames // 2 * ogg.FRAME]


def test_ogg_packets_may_span_pages():
    packet = bytes(1000)
    def page(lacing, body, flags, granule, number):
        head = ogg._HEADER.pack(b"OggS", 0, flags, granule, 9, number, 0, len(lacing)) + bytes(lacing)
        return head[:22] + ogg.page_crc(head + body).to_bytes(4, "little") + head[26:] + body

    media = page([255, 255], packet[:510], 2, -1, 0) + page([255, 235], packet[510:], 1 | 4, 7, 1)
    stream = ogg.read(media)[9]
    assert stream.packets == [packet] and stream.granules == [7]


def test_ogg_faults():
    media = ogg.write(bytes(ogg.FRAME * 4))
    for broken, message in ((media[:-1], "cut"), (media[:60] + b"x" + media[61:], "checksum"), (b"x" + media, "no Ogg page"), (media[: len(media) // 2], "cut")):
        with pytest.raises(ValueError, match=message):
            ogg.read(broken)


def test_ogg_table(docs, none):
    rows = {r["doc_id"]: r for r in ogg.media_columns(docs).collect() if r["doc_id"] is not None}
    assert ogg.media_columns(docs).count() == docs.count()
    for i, t, *_ in docs.collect():
        if i is not None:
            raw = (t or "").encode()
            payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
            assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert ogg.media_columns(none).count() == 0


def test_lpt_equals_a_heap():
    import heapq

    rng = random.Random(3)
    for _ in range(200):
        shards, sizes = rng.choice([1, 2, 3, 8]), sorted({rng.randint(1, 60) for _ in range(rng.randint(1, 12))})
        counts = [rng.randint(1, 30) for _ in sizes]
        heap = [0] * shards
        for size, n in sorted(zip(sizes, counts), reverse=True):
            for _ in range(n):
                heapq.heapreplace(heap, heap[0] + size)
        loads = [0] * shards
        seen = {s: 0 for s in sizes}
        for size, a, b, k in lpt.schedule(np.array(sizes), np.array(counts), shards):
            assert a == seen[size]
            seen[size] = b
            loads[k] += size * (b - a)
        assert seen == dict(zip(sizes, counts)) and sorted(loads) == sorted(heap)


def test_shards_table(docs, none):
    rows = lpt.shard(docs, 4).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs.collect() if i is not None)
    places, loads = {}, {}
    for r in rows:
        places.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        loads.setdefault(r["shard"], []).append((r["slot"], r["size"]))
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(p) == 1 for p in places.values())
    assert all(sorted(s for s, _ in own) == list(range(len(own))) for own in loads.values())
    assert lpt.shard(none).count() == 0


def page(article, menu="Home About", extra=""):
    return f"<html><head><title>T</title><script>if (a</p>b) x</script></head><body><div id=top>{menu}</div><div class=main-text>{article}</div>{extra}<footer>f</footer></body></html>"


def test_wrapper_learns_a_constant_block_without_marks(spark):
    rows = [(i, "http://h.example/x", page(f"<p>story {i} of words<br>goes on</p><p>end&nbsp;{i} &amp; more</p>", extra="<p>Constant words here</p>")) for i in range(6)]
    rows += [(9, "http://other.example/", page("<p>alone</p>")), (10, None, None), (11, "nonsense", ""), (12, "http://h.example/y", "<p>open <b>markup<p>two")]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"story {i} of words goes on\n\nend {i} & more"
    assert got[9] == "Home About\n\nalone" and got[10] == got[11] == "" and got[12] == "open markup\n\ntwo"


def test_wrapper_joins_templates_as_it_sends_them(spark, monkeypatch):
    rows = [(i, "http://h.example/x", page(f"<p>story {i}</p>")) for i in range(6)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    sent = sorted(map(tuple, wrapper.extract_pages(table).collect()))
    monkeypatch.setattr(wrapper, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, wrapper.extract_pages(table).collect())) == sent
    assert wrapper.extract_pages(table.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("copies", [4, 1000])
def test_wrapper_keeps_the_article_of_repeated_pages(spark, copies):
    article = "<article><h1>Title</h1><p>story</p></article>"
    rows = [(i, "http://one.example/", article) for i in range(copies)]
    rows += [(i, None, f"<div class=ad>{i}</div><h1>Copy</h1><p>mirrored</p>") for i in range(copies, copies + 4)]
    rows += [(i, None, f"<h1>Own {i}</h1><p>words {i}</p>") for i in range(copies + 4, copies + 8)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {got[i] for i in range(copies)} == {"Title\n\nstory"}
    assert {got[i] for i in range(copies, copies + 4)} == {"Copy\n\nmirrored"}
    assert all(got[i] == f"Own {i}\n\nwords {i}" for i in range(copies + 4, copies + 8))


def test_a_page_that_is_all_template_keeps_its_text():
    page = wrapper.parse("<h1>Title</h1><p>story</p>")
    assert wrapper.extract(page, wrapper.slot_texts(page)) == "Title\n\nstory"


def test_article_marks_and_named_parts():
    source = (
        "<body><header>site</header><nav>menu</nav><article><header><h1>Title &lt;1&gt;</h1></header><p>one</p><div class='ad'>buy</div><ul><li>a<li>b</ul>"
        "<form>mail</form><section class=comments><p>reader</p></section></article><aside>side</aside><div class=cookie-notice>ok</div></body>"
    )
    assert wrapper.extract(wrapper.parse(source), {}) == "Title <1>\n\none\n\na\n\nb"


@pytest.mark.parametrize(
    "source, text",
    [("<body><div role='banner'>site</div><div><p>story</p></div>", "story"), ("<body><div>story</div><div role='navigation'>menu</div>", "story"),
     ("<body><div>before</div><div role=main>story</div>", "story"), ("<div role='region note'>a</div><div role=''>b</div>", "a\n\nb")],
)
def test_roles_part_siblings(source, text):
    assert wrapper.extract(wrapper.parse(source), {}) == text


@pytest.mark.parametrize(
    "source, text",
    [("<div class='layout with-sidebar'><p>story</p></div><footer>f</footer>", "story"), ("<div class=no-sidebar><article>story</article></div>", "story"),
     ("<div class='page has-comments'><article>story<div class=comments>reader</div></article></div><p>(c)</p>", "story"),
     ("<div class=sidebar-left><article><h1>T</h1><p>story</p></article><div class=sidebar>menu</div></div><p>(c)</p>", "T\n\nstory"),
     ("<form id=aspnet><div class=menu>m</div><main>story</main></form>", "story"), ("<div class=sidebar-left><h1>T</h1><p>story</p><div class=ad>buy</div></div><p>(c)</p>", "T\n\nstory\n\n(c)"),
     ("<article><h2 id='related-work'>Related work</h2><p>a</p><h2 id='search'>Search</h2><section id='form'><p>b</p></section></article>", "Related work\n\na\n\nSearch\n\nb"),
     ("<h2 id='related-work'>Related work</h2><section id=related-work>a</section><section id=cookie-notice>ok</section>", "Related work\n\na"),
     ("<div id=content>a long story</div><div class=related><article>teaser</article></div>", "a long story"),
     ("<div id=content>story</div><div class=comments><article class=comment>a long comment</article></div>", "story"),
     ("<div class=form-wide><p>story</p><p class=ad>buy</p></div>", "story"), ("<article></article><div class=ad><p>buy</p></div>", ""), ("<div class=cookie-notice>ok</div>", "")],
)
def test_names_do_not_hide_the_article(source, text):
    assert wrapper.extract(wrapper.parse(source), {}) == text


def test_settling_time_is_linear():
    import time

    began = time.time()
    wrapper.parse("".join(f"<div class='ad n{i}'>" for i in range(10_000)) + "<article><p>story")
    assert time.time() - began < 20


@pytest.mark.parametrize(
    "source, text",
    [("<p title=it's>a</p><p>don't</p>", "a\n\ndon't"), ('<p title="x>y">a', "a"), ('<p title="x>a<p>b', "a\n\nb"), ("<!-->a<!-- b -->c<!-- d", "ac"), ("a < b <", "a < b <"),
     ("<p>a<table><tr><td>b<td>c</table>d", "a\n\nb\n\nc\n\nd"), ("<script>var a='</p>';</script>x<style>y", "x"), ("&lt;b&gt; &eacute;&#233;&nbsp; z", "<b> éé z"), ("", "")],
)
def test_broken_markup(source, text):
    assert wrapper.extract(wrapper.parse(source), {}) == text


def test_parsing_time_is_linear():
    import time

    for source in ("<a " * 20_000, '<a b="' * 20_000, "<!--" * 20_000, "<p>" * 20_000, "<a b='c" * 20_000):
        began = time.time()
        wrapper.parse(source)
        assert time.time() - began < 20


def test_tree_matching_pairs_what_is_alike():
    one, two = "0 html\n1 div.a\n2 p\n1 div.b", "0 html\n1 span\n1 div.a\n3 p\n1 div.b"
    assert wrapper.align(one, two) == {0: 0, 1: 1, 2: 3, 3: 4, 4: 5}


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 600)
    rows = np.arange(600)
    model = ordinal.fit(np.concatenate([rows, rows]), np.concatenate([10 + grade, rng.integers(100, 120, 600)]), np.ones(1200), grade)
    assert model.thresholds[0] < model.thresholds[1]
    assert model.weights[10] < model.weights[11] < model.weights[12]


def test_ordinal_table(spark, docs, none):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + ("###" if i % 3 == 0 else "") for _ in range(40))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in ordinal.rate(table, labels).collect()}
    assert all(got[i]["kept"] == (i % 3 != 0) for i in range(300))
    assert all(abs(r["expected_grade"] - r["p_good"] - r["p_clean"]) < 1e-9 for r in got.values())
    assert ordinal.rate(docs, labels).count() == docs.count()
    assert ordinal.rate(docs, labels.where("doc_id < 0")).count() == docs.count()
    assert ordinal.rate(none, labels).count() == 0


def test_ordinal_features_do_not_depend_on_the_chunk():
    texts = ["one two two ###", "", "One TWO", "x"]
    whole = next(words.chunks(pa.array(texts)))[1]
    row, bucket, value = ordinal.features(whole)
    for k, text in enumerate(texts):
        _, b, v = ordinal.features(words.of_text(text))
        assert bucket[row == k].tolist() == b.tolist() and value[row == k].tolist() == v.tolist()


def test_ordinal_slope_equals_finite_differences():
    import math

    rng = np.random.default_rng(4)
    row, local, value = np.repeat(np.arange(12), 3), rng.integers(0, 5, 36), rng.random(36)
    grade, w, theta, decay = rng.integers(0, 3, 12), rng.normal(size=5), np.array([-0.3, 0.2]), 0.01

    def likelihood(x):
        total = 0.0
        for i in range(12):
            s = sum(v * x[k] for r, k, v in zip(row, local, value) if r == i)
            p1, p2 = 1 / (1 + math.exp(x[5] - s)), 1 / (1 + math.exp(x[5] + math.exp(x[6]) - s))
            total += math.log((1 - p1, p1 - p2, p2)[grade[i]])
        return total / 12 - decay / 2 * sum(k * k for k in x[:5])

    x = np.concatenate([w, theta])
    steps = np.eye(7) * 1e-6
    wanted = [(likelihood(x + h) - likelihood(x - h)) / 2e-6 for h in steps]
    assert np.allclose(ordinal.slope(w, theta, row, local, value, grade, decay), wanted, atol=1e-6)


def test_ordinal_without_labels_keeps_all_and_columns_of_any_name_stay(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    clashing = docs.withColumnsRenamed({"n_lines": "kept", "rank": "p_good"})
    out = ordinal.keep_rated(clashing, labels)
    assert out.columns == clashing.columns and sorted(map(repr, out.collect())) == sorted(map(repr, clashing.collect()))
    assert ordinal.keep_rated(none, labels).count() == 0


def test_ordinal_fits_one_row_for_each_id(spark):
    rows = spark.createDataFrame([(1, "good words here")] * 50 + [(2, "bad junk there"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert ordinal.train(rows, labels).thresholds[0] == pytest.approx(ordinal.train(rows.limit(0).unionByName(rows.distinct()), labels).thresholds[0])


def test_ordinal_finds_few_words_in_long_texts():
    """Held-out texts with two of ten words among 200 others, which the penalty on squared weights alone finds less often."""
    rng = np.random.default_rng(6)

    def texts(n):
        grade = np.where(rng.random(n) < 0.2, 1, 2)
        rows = [np.concatenate([100 + rng.choice(3000, 200, replace=False), rng.choice(10, 2 * int(g == 1), replace=False)]) for g in grade]
        return np.repeat(np.arange(n), [len(x) for x in rows]), np.concatenate(rows).astype(np.int64), grade

    row, bucket, grade = texts(2000)
    models = [ordinal.fit(row, bucket, np.ones(len(row)), grade), ordinal.fit(row, bucket, np.ones(len(row)), grade, sparsity=0.0, decay=2e-4)]
    row, bucket, grade = texts(1000)
    kept = [ordinal.sigmoid(np.bincount(row, m.weights[bucket]) - m.thresholds[1]) >= 0.5 for m in models]
    sparse, squared = ((k[grade == 1].mean(), k[grade == 2].mean()) for k in kept)
    assert sparse[0] < squared[0] / 2 and sparse[1] > 0.97, (sparse, squared)
