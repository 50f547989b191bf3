"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of the five-word shingles of its lower-cased words; a shorter line is one shingle of all its
words. A line is removed if an earlier line, by document id and line number, has a Jaccard similarity of 0.8 or
more with it. Lines with equal sets form a class, of which only the first line can stay.

Shingles are ordered by rarity: those of lines with some (sampled) shingle in more than ``FREQUENT`` classes' prefixes
are counted over all such lines, and the frequent ones among them come after all others, by that number; the others
count as equally rare and follow their hashes. Classes that share a prefix shingle are
candidates if lengths and positions allow enough common shingles. In long lists members are first compared with the
list's earliest class and with the one that has most of its prefix in lists, so that groups of near copies need no pairs among themselves; then what is not yet removed is
compared with all earlier candidates in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.llm.common import BROADCAST_ROWS, Scratch, table

PERCENT = 80
FREQUENT = 24
LINE_NUMBERS = 8 * BROADCAST_ROWS  # at most that go to every executor, in one set for each document
SAMPLED = 4  # shingles with hashes divisible by this show where frequent passages are


def plain(text: Column) -> Column:
    """A text in lower case, with blanks for tabs and other ASCII white space but line feeds."""
    out = F.lower(text)
    for blank in ("\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return out


def with_shingles(lines: DataFrame) -> DataFrame:
    """Adds ``s``, the sorted distinct shingle hashes of ``line`` (of a plain text); empty for a line without words."""
    # Words' hashes are a variable of a lambda: taken from the row, each would cost a new view of their array.
    worded = lines.withColumn("words", F.array_remove(F.split("line", " "), ""))
    five = "transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4]))"
    fewer = "if(size(h) > 0, array(xxhash64(h)), cast(array() AS array<bigint>))"
    shingles = F.expr(f"transform(array(transform(words, w -> xxhash64(w))), h -> if(size(h) >= 5, {five}, {fewer}))[0]")
    return worded.withColumn("s", F.sort_array(F.array_distinct(shingles))).drop("words")


def numbered_lines(docs: DataFrame, text: Column) -> DataFrame:
    """Lines of all texts: doc_id, text_hash, line_no (from 0), line (of ``text``, the text or the plain one)."""
    return docs.where("text is not null").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    )


def class_hash() -> Column:
    """What a line's class is known by, next to a second hash of its shingles."""
    return F.xxhash64("s")


def _need(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(percent * (n + m) / (100 + percent))


def _prefix(n: Column, percent: int) -> Column:
    return (n - F.ceil(n * percent / 100) + 1).cast("int")


def _pairs(later: DataFrame, earlier: DataFrame, percent: int) -> DataFrame:
    """Candidates (x, y) with y the earlier: they meet in a prefix and could share enough shingles."""
    a = later.select("token", *(F.col(c).alias(f"x_{c}") for c in ("cls", "n", "at", "first", "e")))
    b = earlier.select("token", *(F.col(c).alias(f"y_{c}") for c in ("cls", "n", "at", "first", "e")))
    n, m, i, j = (F.col(c) for c in ("x_n", "y_n", "x_at", "y_at"))
    rest = F.greatest(F.ceil(n * percent / 100), F.ceil(m * percent / 100)) - 1
    return (
        a.join(b, "token")
        .where((F.col("y_first") < F.col("x_first")) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent))
        .where(F.least(i, j) + F.least(n - i, m - j) >= _need(n, m, percent))
        .where(F.least("x_e", "y_e") + rest >= _need(n, m, percent))
        .groupBy(F.col("x_cls").alias("x"), F.col("y_cls").alias("y"), "x_n", "y_n")
        .agg(F.count(F.lit(1)).alias("k"))
        .where(F.col("k") + rest >= _need(n, m, percent))
    )


def _sets(docs: DataFrame, firsts: DataFrame, classes: DataFrame, own: Scratch) -> DataFrame:
    """A table of cls and s of the ``classes`` (cls), read at their first lines; only the documents of these are split.

    It is written at once: a filter that is pushed below the shingles would compute the words again for each shingle.
    """
    places = own.table(firsts.join(own.small(classes), "cls").select("cls", "first.*"), "places")
    at = own.small(places, F.col("cls"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("line_no").alias("l"))
    texts = docs.where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(own.small(places, F.col("text_hash")), "text_hash", "left_semi").select("doc_id", "text")
    same = (F.col("text_hash") == F.col("t")) & (F.col("line_no") == F.col("l")) & F.col("doc_id").eqNullSafe(F.col("d"))
    lines = numbered_lines(texts, F.col("text")).join(at, same).select("cls", plain(F.col("line")).alias("line"))
    sets = own.table(with_shingles(lines).select("cls", "s"), "sets")
    own.drop(places)
    return sets


def _verified(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, percent: int, own: Scratch) -> DataFrame:
    """The classes ``x`` of pairs whose sets are similar, compared in full."""
    wanted = own.table(pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct(), "wanted")
    sets = _sets(docs, firsts, wanted, own)
    both = pairs.select("x", "y").join(sets.select(F.col("cls").alias("x"), F.col("s").alias("sx")), "x")
    both = both.join(sets.select(F.col("cls").alias("y"), F.col("s").alias("sy")), "y")
    common = F.size(F.array_intersect("sx", "sy"))
    gone = both.where(common * 100 >= (F.size("sx") + F.size("sy") - common) * percent).select(F.col("x").alias("cls")).distinct()
    gone = own.table(gone, "gone")
    own.drop(wanted, sets)
    return gone


def _members(docs: DataFrame, percent: int, own: Scratch) -> tuple[DataFrame, DataFrame]:
    """All lines with words (doc_id, text_hash, line_no, cls, n, prefix), and each class's first place, size and number of lines."""
    n = F.size("s")
    # No filter on the shingles here: pushed down, it would compute the words again for each shingle.
    lines = with_shingles(numbered_lines(docs, plain(F.col("text")))).select(
        "doc_id", "text_hash", "line_no", class_hash().alias("cls"), F.hash("s").alias("second"), n.alias("n"),
        F.slice("s", 1, F.greatest(_prefix(n, percent), F.lit(0))).alias("prefix"),
    )
    members = own.table(lines, "lines").where("n > 0")

    def grouped(rows: DataFrame) -> DataFrame:
        first = F.min(F.struct("doc_id", "text_hash", "line_no")).alias("first")
        firsts = rows.groupBy("cls").agg(first, F.max("n").alias("n"), F.count(F.lit(1)).alias("k"), F.min("second").alias("lo"), F.max("second").alias("hi"))
        return own.table(firsts, "firsts", F.count_if(F.col("lo") != F.col("hi")).alias("clashes"))

    firsts = grouped(members)
    if own.seen(firsts)["clashes"]:  # different sets with the same hash are told apart by the second one
        clash = own.table(firsts.where("lo <> hi").select("cls", F.lit(True).alias("clash")), "clash")
        cls = F.when(F.col("clash"), F.xxhash64("cls", "second")).otherwise(F.col("cls"))
        members = own.table(members.join(own.small(clash), "cls", "left").withColumn("cls", cls).drop("clash"), "lines")
        firsts = grouped(members)
    return members, firsts


def _lists(docs: DataFrame, members: DataFrame, firsts: DataFrame, percent: int, own: Scratch) -> DataFrame:
    """Entries of the prefix lists of at least two classes: token, cls, n, at (place in the prefix), first, e (entries of the class)."""
    # Where frequent passages are is seen in the shingles of one hash residue, over all lines.
    entries = members.select("cls", F.explode("prefix").alias("token"))
    some = entries.where(F.pmod("token", F.lit(SAMPLED)) == 0).groupBy("token")
    often = some.agg(F.count(F.lit(1)).alias("c"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where((F.col("c") > FREQUENT) & (F.col("lo") != F.col("hi")))
    hits = own.table(entries.join(own.small(own.table(often.select("token"), "often")), "token").select("token", "cls").distinct(), "hits")
    often = own.table(hits.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > FREQUENT).select("token"), "often")
    struck = own.table(hits.join(own.small(often), "token", "left_semi").select("cls").distinct(), "struck")
    # All shingles of these lines are counted: what stands around a frequent shingle mostly is as frequent.
    sets = _sets(docs, firsts, struck, own)
    full = sets.select("cls", F.size("s").alias("n"), F.explode("s").alias("token"))
    late = own.table(full.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > FREQUENT), "late")
    moved = own.table(entries.join(own.small(late), "token").select("cls").distinct(), "moved")
    rest = own.table(moved.join(struck, "cls", "left_anti"), "rest")
    newly = _sets(docs, firsts, rest, own)
    again = only(full, moved, own).unionByName(newly.select("cls", F.size("s").alias("n"), F.explode("s").alias("token"))).join(own.small(late), "token", "left")
    order = Window.partitionBy("cls").orderBy(F.coalesce("c", F.lit(0)), "token")
    again = again.withColumn("at", F.row_number().over(order)).where(F.col("at") <= _prefix(F.col("n"), percent))
    again = own.table(again.select("token", "cls", F.col("at").cast("long")), "again")
    own.drop(sets, newly)
    # One line of each class is enough from here on.
    repeated = own.table(firsts.where("k > 1").select("cls", F.col("first").alias("one")), "repeated")
    single = members.join(own.small(repeated), "cls", "left").where(F.col("one").isNull() | (F.col("one") == F.struct("doc_id", "text_hash", "line_no")))
    stay = only(single, moved, own, "left_anti")
    entries = stay.select("cls", F.explode("prefix").alias("token")).unionByName(again.select("cls", "token"))
    # A shingle that two rows have needs no second look: its classes are the smaller and the larger one.
    met = entries.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi")
    met = own.table(met, "met")
    more = entries.join(own.small(own.table(met.where("c > 2").select("token"), "more")), "token").select("token", "cls").distinct()
    shared = own.table(met.where("c = 2").select("token", F.explode(F.array("lo", "hi")).alias("cls")).unionByName(more), "shared")
    own.drop(met)
    kept = only(shared, moved, own, "left_anti")
    wanted = own.table(kept.select("cls").distinct(), "wanted")
    # A class's size and first place come with its one line, by shuffle: for every executor they would be too much.
    prefixes = only(single, wanted, own).select("cls", "prefix", "n", F.struct("doc_id", "text_hash", "line_no").alias("first"))
    kept = kept.join(prefixes, "cls").withColumn("at", F.array_position("prefix", F.col("token")))
    again = again.join(shared, ["token", "cls"]).join(only(firsts.select("cls", "n", "first"), moved, own), "cls")
    # No pair shares more prefix shingles than one of its sets has in lists at all.
    e = F.count(F.lit(1)).over(Window.partitionBy("cls")).alias("e")
    kept, again = (df.select("token", "cls", "n", "at", "first", e) for df in (kept, again))
    lists = own.table(kept.unionByName(again), "lists")
    own.drop(shared)
    return lists


def only(rows: DataFrame, classes: DataFrame, own: Scratch, how: str = "left_semi") -> DataFrame:
    """Rows whose class is (not) in the table ``classes``."""
    return rows.join(own.small(classes, F.col("cls")), "cls", how)


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash and line_no of every line that an earlier line makes redundant.

    Lines without words and null texts have none. Rows with equal id and text count as one document; among other
    rows of one id, or of null ids, which come first, the text's hash decides which is earlier.
    """
    with Scratch(docs.sparkSession) as own:
        docs = docs.select(F.col("doc_id").cast("long"), "text")
        repeated = docs.select("doc_id", F.xxhash64("text").alias("t")).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("k"))
        if (repeated.agg(F.max("k")).first()[0] or 0) > 1:
            docs = own.table(docs.distinct(), "documents")
        members, firsts = _members(docs, percent, own)
        lists = _lists(docs, members, firsts, percent, own)

        crowded = own.table(lists.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > FREQUENT).select("token"), "crowded")
        long = own.table(lists.join(own.small(crowded), "token"), "long")
        near = None
        for lead in (F.struct("first"), F.struct(-F.col("e") / _prefix(F.col("n"), percent), "first")):
            heads = long.groupBy("token").agg(F.min(F.struct(lead.alias("lead"), "cls", "n", "at", "first", "e")).alias("head")).select("token", "head.*")
            best = _pairs(long, heads, percent).groupBy("x").agg(F.max_by("y", F.struct("k", "y")).alias("y"))
            near = best if near is None else near.unionByName(best).distinct()
        gone = _verified(docs, firsts, own.table(near, "near"), percent, own)
        pairs = own.table(_pairs(only(lists, gone, own, "left_anti"), lists, percent).select("x", "y"), "pairs")
        own.drop(lists, long)
        gone = gone.unionByName(_verified(docs, firsts, pairs, percent, own)).distinct().withColumn("gone", F.lit(True))

        lost = firsts.join(gone, "cls", "left").where("gone or k > 1").select("cls", "first", "gone")
        state = members.select("doc_id", "text_hash", "line_no", "cls").join(own.small(own.table(lost, "lost")), "cls")
        redundant = state.where(F.col("gone") | (F.col("first") != F.struct("doc_id", "text_hash", "line_no")))
        return own.keep(own.table(redundant.select("doc_id", "text_hash", "line_no"), "removed"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, counts: bool = True) -> DataFrame:
    """All documents without their removed lines; other columns stay, and ``n_lines`` and ``n_removed`` are added.

    A null text stays null and has no lines; an empty text is one line without words, which stays, as all such
    lines do. An empty table gives no rows. Columns of ``docs`` named n_lines or n_removed are replaced; without
    ``counts`` all columns stay as they are and none is added. Column names are compared as Spark does, without case.
    """
    added = ["n_lines", "n_removed"] if counts else []
    names = [c for c in docs.columns if c.lower() not in added]
    removed = removed_lines(docs, percent)
    gone = removed.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone")).select(F.struct("doc_id", "text_hash").alias("at"), "gone")
    # What goes to every executor has a row for each document, not for each line.
    k = removed.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)), F.sum("k")).first()
    gone = F.broadcast(gone) if k[0] <= BROADCAST_ROWS and (k[1] or 0) <= LINE_NUMBERS else gone
    # Documents are one column of their own, so that no name of theirs can clash.
    own = docs.select(F.struct(*names).alias("own"), F.col("text").alias("text"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    joined = own.join(gone, F.col("id").eqNullSafe(F.col("at.doc_id")) & (F.col("hash") == F.col("at.text_hash")), "left")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")
    )
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    columns = [text.alias(c) if c.lower() == "text" else F.col("own").getField(c).alias(c) for c in names]
    if counts:
        columns += [F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*columns)


def op10_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, u.i - 1 AS line_no, u.line AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL) d,
       LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS i) u
), worded AS (
  SELECT doc_id, line_no, list_filter(regexp_split_to_array(lower(line), '[ \t\r\x0B\x0C]+'), lambda x: x <> '') AS w FROM lines
), shingled AS (
  SELECT doc_id, line_no, list_sort(list_distinct(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM worded
), placed AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS ord, dense_rank() OVER (ORDER BY s) AS cls FROM shingled WHERE len(s) > 0
), classes AS (
  SELECT cls, any_value(s) AS s, any_value(len(s)) AS n, min(ord) AS first FROM placed GROUP BY cls
), tokens AS (SELECT cls, n, first, unnest(s) AS t FROM classes
), ranked AS (
  SELECT cls, n, first, t, row_number() OVER (PARTITION BY cls ORDER BY c, t) AS rk
  FROM tokens JOIN (SELECT t, count(*) AS c FROM tokens GROUP BY t) USING (t)
), heads AS (SELECT * FROM ranked WHERE rk <= n - (80 * n + 99) // 100 + 1
), pairs AS (
  SELECT DISTINCT a.cls AS x, b.cls AS y FROM heads a JOIN heads b ON a.t = b.t AND b.first < a.first
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), gone AS (
  SELECT DISTINCT x AS cls FROM (
    SELECT x, a.n AS n, b.n AS m, len(list_intersect(a.s, b.s)) AS k FROM pairs JOIN classes a ON a.cls = x JOIN classes b ON b.cls = y)
  WHERE 100 * k >= 80 * (n + m - k)
), removed AS (
  SELECT doc_id, line_no FROM placed JOIN classes USING (cls) WHERE ord <> first OR cls IN (SELECT cls FROM gone)
), rest AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text
  FROM lines l ANTI JOIN removed r ON l.doc_id = r.doc_id AND l.line_no = r.line_no GROUP BY l.doc_id
), counted AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id
), lost AS (SELECT doc_id, count(*) AS n_removed FROM removed GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text,
  coalesce(c.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN rest r USING (doc_id) LEFT JOIN counted c USING (doc_id) LEFT JOIN lost x USING (doc_id)
"""
