"""HTML extraction by wrapper induction.

Each page is parsed to a tree, and siblings of one kind are folded to a slot, so that lists of any length have
one shape. The shapes of a host's pages are aligned to the host's commonest shape by simple tree matching. A slot
whose text is the same on most of the aligned pages is template; slots whose text varies hold content. Pages of a
host that have the same text, apart from what markup leaves out, count once, so that copies of a page don't make its
article template; and if all the text of a page is template, it is kept. Pages are never brought together by host:
shapes, alignments and text counts are small tables keyed by host.

Elements that HTML itself or their class names as menus, headers, footers, sidebars, notices, adverts, forms or
comments are left out as well, and if a page marks its article, only that is taken. Names don't count if the page
says otherwise: of an element around its article, around its heading and most of its text, or if nothing else is left.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import takewhile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import materialise, table

LEAST_PAGES = 4  # different pages that must agree before a slot is template
SHARE = 0.5  # of the aligned pages that must have the same text outside the article, and inside it:
SHARE_INSIDE = 0.9
BROADCAST_ROWS = 200_000  # rows of templates at most that go to every executor; more are joined

# A quote counts after an equals sign only; an open quote or an open comment ends where it must.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""",
    re.DOTALL,
)
_OPEN = re.compile(r"<()(!)(--|\[CDATA\[|[a-zA-Z?]).*\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
_KEEPS_PARAGRAPH = _INLINE | {"option", "source", "track", "area", "param", "input", "button", "select", "textarea", "script", "style", "object", "svg"}
_DROPPED = set("head title script style noscript template iframe nav aside footer form button select textarea input svg canvas dialog object menu".split())
_MARKED = set(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup "
    "modal overlay sidebar aside menu nav navbar navigation navigator breadcrumb breadcrumbs pagination pager footer comment comments "
    "commentlist disqus respond reply replies newsletter subscribe subscription signup login share sharing social related recommended "
    "toolbar skip widget form search".split()
)
_OUTSIDE = {"header", "masthead", "topbar", "site-header"}
_STATES = {"with", "without", "no", "not", "has", "have"}  # what follows in a class says what else the page has
_LAYOUTS = {"layout", "page"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}


class Page(NamedTuple):
    """``slots``: (parent, label) in page order; ``pieces``: (slot, block, text); ``kinds``: of a slot 'x' left out, 'a' in an article, 'm' in main, else ' '."""

    slots: list[tuple[int, str]]
    pieces: list[tuple[int, int, str]]
    kinds: list[str]


def _named(tag: str, classes: list[str], ids: list[str], inside: bool) -> bool:
    """Whether classes or ids name a part to leave out. Ids of headings and sections are mostly slugs of their titles."""
    for name in classes:
        parts = re.split(r"[^a-z0-9]+", name)
        if parts[-1] in _LAYOUTS:
            continue
        own = {*takewhile(lambda x: x not in _STATES, parts), name}
        if own & _MARKED or not inside and own & _OUTSIDE:
            return True
    if tag in _HEADINGS:
        return False
    box = tag in ("div", "ul", "ol") and "section" not in classes
    for name in ids:
        parts = [*takewhile(lambda x: x not in _STATES, re.split(r"[^a-z0-9]+", name))]
        if inside:
            if box and name in _MARKED:
                return True
        elif box and parts and parts[-1] not in _LAYOUTS:
            if {*parts, name} & (_MARKED | _OUTSIDE):
                return True
        elif parts and _MARKED.issuperset(parts):
            return True
    return False


def _kind(tag: str, attributes: str, above: str, trusted: bool = True) -> tuple[str, str]:
    """Label and kind of an element below one of kind ``above``. The label has all that decides the kind, so siblings of one label are of one kind.

    Unless ``trusted``, names, roles and being a form don't leave it out.
    """
    role, classes, ids = "", [], []
    if attributes and "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values).lower().split()
            if name.lower() == "role":
                role = value[0] if value else ""
            else:
                (classes if name.lower() == "class" else ids).extend(value)
    label = (f"{tag}@{role}" if role else tag) + (f".{' '.join(classes)}" if classes else "") + (f"#{' '.join(ids)}" if ids else "")
    if above == "x" or tag in _DROPPED and (trusted or tag != "form") or trusted and role in _ROLES:
        return label, "x"
    inside = above in "am"
    if trusted and (classes or ids) and tag not in ("html", "body") and _named(tag, classes, ids, inside):
        return label, "x"
    if tag == "header" and not inside:
        return label, "x"
    if tag == "article":
        return label, "a"
    if tag == "main" or role == "main":
        return label, "a" if above == "a" else "m"
    return label, above


def _settled(page: Page, heads: list[tuple[str, str]]) -> list[str]:
    """The kinds of a page's slots, given all of it. ``heads``: tag and attributes of each slot.

    If text is kept in an article or main, nothing changes. Otherwise names, roles and forms lose their say on the
    elements around articles with more text than is kept, around a first-level heading in a part with most of the
    text, or, if nothing is kept, around the longest paragraph or heading.
    """
    slots, kinds, n = page.slots, page.kinds, len(page.slots)
    size = [0] * n
    for slot, _, text in page.pieces:
        size[slot] += len(text.strip())
    if any(size[i] and kinds[i] in "am" for i in range(n)):
        return kinds
    # Of each slot: its kind without trust, whether that changed it, the outermost such slot, and its article if none is between.
    plain, soft, top, article = [" "], [False], [0], [0]
    for i in range(1, n):
        parent = slots[i][0]
        label, kind = _kind(*heads[i], plain[parent], False)
        plain.append(kind)
        soft.append(kind != "x" and _kind(*heads[i], plain[parent])[1] == "x")
        top.append(top[parent] or (i if soft[i] else 0))
        marks = (head := label.split(".")[0].split("#")[0]) in ("article", "main") or head.endswith("@main")
        article.append(0 if soft[i] or kind == "x" else article[parent] or (i if marks else 0))
    kept = sum(size[i] for i in range(n) if kinds[i] != "x")
    mass, marked = [0] * n, [0] * n
    for i in range(n):
        if plain[i] != "x":
            mass[top[i]] += size[i]
            if article[i]:
                marked[top[i]] += size[i]
    anchors: list[int] = []
    best = max(range(1, n), key=lambda i: marked[i], default=0)
    if best and marked[best] > kept:
        anchors = [i for i in range(n) if top[i] == best and article[i] and size[i]]
    elif not any(kinds[i] in "am" for i in range(n)):
        open_ = [i for i in range(1, n) if top[i] and plain[i] != "x" and not soft[i] and size[i]]
        anchors = [i for i in open_ if heads[i][0] == "h1" and 2 * mass[top[i]] > sum(mass)]
        if not anchors and not kept:
            anchors = sorted((i for i in open_ if heads[i][0] in _HEADINGS or heads[i][0] in ("p", "pre", "blockquote")), key=lambda i: -size[i])[:1]
    free: set[int] = set()
    for i in anchors:
        while i and i not in free:
            free.add(i)
            i = slots[i][0]
    if not free:
        return kinds
    kinds = [" "]
    for i in range(1, n):
        kinds.append(_kind(*heads[i], kinds[slots[i][0]], i not in free)[1])
    return kinds


def parse(source: str) -> Page:
    """The folded tree of a page. Broken markup is taken as it comes: an end tag closes what is open inside it."""
    slots: list[tuple[int, str]] = [(-1, "")]
    index: dict[tuple[int, str], int] = {}
    kinds, heads, doubt = [" "], [("", "")], False
    pieces: list[tuple[int, int, str]] = []
    tags, path = [""], [0]
    block, at, size = 0, 0, len(source)
    tokens, last = _TOKEN, source.rfind(">") + 1  # nothing but an open comment can begin after the last end of a tag
    while at < size:
        found = tokens.search(source, at, last) if at < last else _OPEN.search(source, at)
        text = source[at : found.start()] if found else source[at:]
        if text:
            pieces.append((path[-1], block, text))
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None or tag == "!":
            if found[0].startswith("<![CDATA["):
                pieces.append((path[-1], block, html.escape(found[0][9:].removesuffix("]]>"))))
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            block += 1
        if found[1]:
            if tag in tags:
                while tags.pop() != tag:
                    path.pop()
                path.pop()
            continue
        if tag == "br":
            pieces.append((path[-1], block, " "))
            continue
        if "p" in tags and tag not in _KEEPS_PARAGRAPH:
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] == "p":
                    del tags[i:], path[i:]
                    break
                if tags[i] not in _KEEPS_PARAGRAPH:
                    break
        if tag in _CLOSES:
            closed, limit = _CLOSES[tag]
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] in limit:
                    break
                if tags[i] in closed:
                    del tags[i:], path[i:]
                    break
        label, kind = _kind(tag, found[3], kinds[path[-1]])
        key = (path[-1], label)
        slot = index.get(key)
        if slot is None:
            slot = index[key] = len(slots)
            slots.append(key)
            kinds.append(kind)
            heads.append((tag, found[3]))
            doubt = doubt or kind == "x" and (tag in ("article", "main", "h1") or "main" in found[3].lower())
        if tag in _VOID or found[3].endswith("/") and tag not in _INLINE and tag not in _RAW:
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
            if body := source[at : end.start() if end else size]:
                pieces.append((slot, block, body))
            at = end.end() if end else size
            continue
        tags.append(tag)
        path.append(slot)
    page = Page(slots, pieces, kinds)
    if doubt or not any(kinds[slot] != "x" and not text.isspace() for slot, _, text in pieces):
        page = page._replace(kinds=_settled(page, heads))
    return page


def shape(page: Page) -> str:
    """A page's folded tree as text."""
    return "\n".join(f"{parent} {label}" for parent, label in page.slots[1:])


def slot_texts(page: Page) -> dict[int, int]:
    """A hash of all text in each slot that has some."""
    own: dict[int, list[str]] = {}
    for slot, _, text in page.pieces:
        if not text.isspace():
            own.setdefault(slot, []).append(text)
    return {slot: xxhash.xxh64_intdigest("\0".join(" ".join(t.split()) for t in texts)) - (1 << 63) for slot, texts in own.items()}


@lru_cache(maxsize=4096)
def align(one: str, two: str) -> dict[int, int]:
    """Slots of shape ``one`` and the slots of ``two`` that simple tree matching pairs with them."""

    def tree(text: str) -> tuple[list[str], list[list[int]]]:
        labels, children = [""], [[]]
        for i, line in enumerate(text.split("\n") if text else [], 1):
            parent, label = line.split(" ", 1)
            labels.append(label)
            children.append([])
            children[int(parent)].append(i)
        return labels, children

    (la, ca), (lb, cb) = tree(one), tree(two)
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        if (a, b) in known:
            return known[a, b]
        rows, columns = ca[a], cb[b]
        best = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
        for i, x in enumerate(rows, 1):
            for j, y in enumerate(columns, 1):
                both = match(x, y)[0] + best[i - 1][j - 1] if la[x] == lb[y] else 0
                best[i][j] = max(best[i - 1][j], best[i][j - 1], both)
        pairs, i, j = [], len(rows), len(columns)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((rows[i], columns[j]))
        known[a, b] = best[-1][-1] + 1, pairs
        return known[a, b]

    found, todo = {0: 0}, [(0, 0)]
    match(0, 0)
    while todo:
        pair = todo.pop()
        for x, y in match(*pair)[1]:
            found[x] = y
            todo.append((x, y))
    return found


def extract(page: Page, template: dict[int, int]) -> str:
    """The main text: blocks of the slots that hold content. ``template``: slots whose text with that hash is template.

    If the template leaves nothing, the text without it.
    """
    texts = slot_texts(page) if template else {}
    fixed = {slot for slot, text in template.items() if texts.get(slot) == text}
    usable = [p for p in page.pieces if page.kinds[p[0]] != "x" and p[0] not in fixed]
    for kind in "am":
        if own := [p for p in usable if page.kinds[p[0]] == kind or kind == "m" and page.kinds[p[0]] == "a"]:
            if any(not t.isspace() for _, _, t in own):
                usable = own
                break
    blocks: dict[int, list[str]] = {}
    for _, block, text in usable:
        blocks.setdefault(block, []).append(text)
    done = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    text = "\n\n".join(b for b in done if b)
    return extract(page, {}) if fixed and not text else text


def host(url: str | None) -> str:
    """The lower-case host of a URL; empty for none."""
    found = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, shape, and slots with their text hashes of each page, once per batch; slots that markup leaves out don't count."""
    for batch in batches:
        seen: dict[tuple[str, str, tuple[tuple[int, int], ...]], None] = {}
        for url, source in zip(batch.column(0), batch.column(1)):
            page = parse(source.as_py() or "")
            if texts := tuple(sorted((slot, text) for slot, text in slot_texts(page).items() if page.kinds[slot] != "x")):
                seen[host(url.as_py()), shape(page), texts] = None
        if seen:
            names, shapes, texts = zip(*seen)
            ends = np.cumsum([0, *map(len, texts)], dtype=np.int32)
            slots, hashes = zip(*(pair for own in texts for pair in own))
            columns = [pa.array(names, pa.string()), pa.array(shapes, pa.string()), pa.ListArray.from_arrays(ends, pa.array(slots, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(hashes, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "shape", "slots", "hashes"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of each shape and their slots in the host's commonest shape, with whether they are in an article."""
    for batch in batches:
        rows = []
        for name, one, two in zip(*(batch.column(i).to_pylist() for i in range(3))):
            inside = [False]
            for line in two.split("\n") if two else []:
                parent, label = line.split(" ", 1)
                inside.append(inside[int(parent)] or (head := label.split(".")[0].split("#")[0]) in ("article", "main") or head.endswith("@main"))
            rows += [(name, one, a, b, inside[b]) for a, b in align(one, two).items()]
        if rows:
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["host", "shape", "slot", "common", "inside"])


def induce(pages: DataFrame) -> DataFrame:
    """Template slots of every host and shape: host, shape, slot, text_hash."""
    contents = pages.select("url", "html").mapInArrow(_outline, "host string, shape string, slots array<int>, hashes array<bigint>").distinct()
    slots = contents.select("host", "shape", F.explode(F.arrays_zip("slots", "hashes")).alias("s"))
    seen = materialise(
        slots.groupBy("host", "shape", F.col("s.slots").alias("slot"), F.col("s.hashes").alias("text_hash")).agg(F.count(F.lit(1)).alias("k")), "slots"
    )
    shapes = seen.groupBy("host", "shape", "slot").agg(F.sum("k").alias("k")).groupBy("host", "shape").agg(F.max("k").alias("k"))
    shapes = materialise(shapes, "shapes")
    common = shapes.groupBy("host").agg(F.max_by("shape", F.struct("k", "shape")).alias("best"))
    pairs = shapes.join(common, "host").select("host", "shape", "best")
    slots = materialise(pairs.mapInArrow(_aligned, "host string, shape string, slot int, common int, inside boolean"), "aligned")
    texts = materialise(
        seen.join(slots, ["host", "shape", "slot"]).groupBy("host", "common", "inside", "text_hash").agg(F.sum("k").alias("k")), "texts"
    )
    shares = texts.groupBy("host", "common", "inside").agg(F.sum("k").alias("all"), F.max_by("text_hash", F.struct("k", "text_hash")).alias("text_hash"), F.max("k").alias("k"))
    fixed = shares.where(
        (F.col("k") >= LEAST_PAGES) & (F.col("k") >= F.col("all") * F.when(F.col("inside"), F.lit(SHARE_INSIDE)).otherwise(F.lit(SHARE)))
    )
    return slots.join(fixed.select("host", "common", "text_hash"), ["host", "common"]).select("host", "shape", "slot", "text_hash")


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of every page (``page_id``, ``url``, ``html``; other columns are ignored).

    Columns: page_id, url, text (empty if there is none), n_chars. A null html counts as empty, pages without a
    host form one group, repeated rows are kept but count once for the template, and an empty table gives no rows. A
    page whose host has too few different pages has no template and keeps all that markup doesn't name, and so does a
    page whose whole text is template.
    """
    rows = materialise(induce(pages), "templates")
    schema = "page_id bigint, url string, text string, n_chars bigint"
    own = pages.select(F.col("page_id").cast("long"), "url", "html")

    def result(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        n = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    if rows.count() <= BROADCAST_ROWS:
        templates: dict[tuple[str, str], dict[int, int]] = {}
        for name, form, slot, text in rows.toLocalIterator():
            templates.setdefault((name, form), {})[slot] = text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = []
                for url, source in zip(batch.column(1), batch.column(2)):
                    page = parse(source.as_py() or "")
                    texts.append(extract(page, templates.get((host(url.as_py()), shape(page)), {})))
                yield result(batch, texts)

        return own.mapInArrow(run, schema)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array([host(u) for u in batch.column(1).to_pylist()], pa.string())
            shapes = pa.array([shape(parse(h or "")) for h in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, shapes], ["page_id", "url", "html", "host", "shape"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield result(batch, [extract(parse(h or ""), {x["slot"]: x["text_hash"] for x in t or []}) for h, t in found])

    grouped = rows.groupBy("host", "shape").agg(F.collect_list(F.struct("slot", "text_hash")).alias("template"))
    wide = own.mapInArrow(keyed, "page_id bigint, url string, html string, host string, shape string")
    return wide.join(grouped, ["host", "shape"], "left").select("page_id", "url", "html", "template").mapInArrow(joined, schema)


def op8_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
