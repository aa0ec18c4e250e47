"""Near-duplicate lines: a segment-partition edit join (built-in functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, salted_join, written

#: Insertions, deletions and substitutions of characters that still make a duplicate.
EDITS = 2
#: Characters of the longer line for each edit: shorter lines are allowed fewer.
CHARS_PER_EDIT = 10
#: Different line lengths that are broadcast at most; more are joined by a shuffle.
BROADCAST_LENGTHS = 100_000
#: A segment of more lines than this is crowded; of large tables a share of all segments, so that those stay few.
CROWDED = 32
CROWDED_KEYS = 500_000
#: Numbers of candidate lines that are broadcast at most, to read no other text; more are joined by a shuffle.
BROADCAST_LINES = 1_000_000
_LETTERS = "etaniohs"


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) for each line of each text; a null text has one empty line."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def allowed(n: str, edits: int = EDITS) -> str:
    """SQL: the edits between two lines of which the longer has ``n`` characters."""
    return f"least({edits}, {n} div {CHARS_PER_EDIT})"


def _starts(edits: int) -> str:
    """SQL: for a line of ``n`` characters, structs (edits t, length l, segment i, start p, size z) to probe.

    Segment i of the ``edits + 1`` even segments of a line of length l <= n. A segment that
    survives can only have moved by as much as the edits left and right of it allow.
    """
    parts = edits + 1
    size = f"(l div {parts} + if(i >= {parts} - l % {parts}, 1, 0))"
    begin = f"(i * (l div {parts}) + greatest(0, i - ({parts} - l % {parts})))"
    low = f"greatest(0, {begin} - i, {begin} + (n - l) - ({edits} - i))"
    high = f"least(n - {size}, {begin} + i, {begin} + (n - l) + ({edits} - i))"
    return (
        f"flatten(transform(sequence(greatest({parts}, n - {edits}), n), l -> "
        f"flatten(transform(sequence(0, {edits}), i -> transform("
        f"filter(sequence({low}, greatest({low}, {high})), p -> p <= {high}), "
        f"p -> struct({edits} as t, l as l, i as i, p as p, {size} as z))))))"
    )


def _segments(edits: int) -> str:
    """SQL: the line's own segments in the same form."""
    parts = edits + 1
    size = f"(n div {parts} + if(i >= {parts} - n % {parts}, 1, 0))"
    begin = f"(i * (n div {parts}) + greatest(0, i - ({parts} - n % {parts})))"
    return f"transform(sequence(0, {edits}), i -> struct({edits} as t, n as l, i as i, {begin} as p, {size} as z))"


def _places(edits: int, probe: bool) -> str:
    """SQL: all places of a line of ``n`` characters, for each number of edits that it can be compared with."""
    each = []
    for t in range(1, edits + 1):
        # probed by the longer line; the shorter one has up to t characters less
        most = "" if t == edits else f" and n < {(t + 1) * CHARS_PER_EDIT}"
        least = t * CHARS_PER_EDIT if probe else t * CHARS_PER_EDIT - t
        each.append(f"if(n >= {least}{most}, {_starts(t) if probe else _segments(t)}, array())")
    return f"concat({', '.join(each)})"


def _letter_counts(line: str) -> Column:
    """How often eight frequent letters occur, modulo 16, in four bits each."""
    count = lambda x: F.octet_length(line) - F.octet_length(F.replace(line, F.lit(x)))
    each = [F.shiftleft(count(x).bitwiseAND(F.lit(15)), 4 * k) for k, x in enumerate(_LETTERS)]
    return reduce(lambda a, b: a.bitwiseOR(b), each)


def _count_difference(a: str, b: str) -> Column:
    """A lower bound of the letters' differences: each edit adds 2 at most."""
    nibble = lambda c, k: F.shiftrightunsigned(F.col(c), 4 * k).bitwiseAND(F.lit(15))
    apart = [F.abs(nibble(a, k) - nibble(b, k)) for k in range(len(_LETTERS))]
    return reduce(lambda x, y: x + y, [F.least(d, 16 - d) for d in apart])


def _texts(lines: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, x) and (b, y): the lines of some ids, under the names of either side of a pair."""
    wanted = written(ids.distinct())
    hint = F.broadcast if wanted.count() <= BROADCAST_LINES else (lambda df: df)
    found = lines.join(hint(wanted), "id", "left_semi")
    return tuple(found.select(F.col("id").alias(n), F.col("line").alias(t)) for n, t in (("a", "x"), ("b", "y")))


def sized(lines: DataFrame) -> DataFrame:
    """Lines (id, line) with what pairs are sorted out by: characters ``n`` and counts of letters ``c``."""
    return lines.select("id", "line", F.char_length("line").alias("n"), _letter_counts("line").alias("c"))


def edit_links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b) ids of the distinct lines, as :func:`sized` has them and written, within the edits allowed for the longer one.

    Each line is indexed under its own segments and probes the segments of lines as long
    as it or up to ``edits`` shorter; by the pigeonhole principle a pair within the
    threshold meets. Pairs whose counts of eight letters differ by more than the edits
    could change go at once. The others are verified by the banded edit distance: those
    that meet in a segment of many lines inside the join, so that no list of pairs is
    written that grows with the square of such a group, the rest afterwards.
    """
    lengths = written(lines.select("n").distinct())
    hint = F.broadcast if lengths.count() <= BROADCAST_LENGTHS else (lambda x: x)

    def keys(probe: bool) -> DataFrame:
        # written, or Spark would infer a filter that lists the places of each line anew
        found = written(lengths.select("n", F.expr(_places(edits, probe)).alias("places")).where(F.size("places") > 0))
        each = lines.join(hint(found), "n").select("id", "n", "c", "line", F.explode("places").alias("s"))
        return each.withColumn("key", F.xxhash64("s.t", "s.l", "s.i", F.substring("line", F.col("s.p") + 1, F.col("s.z")))).drop("s")

    index = keys(False)
    counts = index.groupBy("key").agg(F.count("*").alias("m"))
    shared = written(counts.where(F.col("m") > CROWDED))
    limit = max(CROWDED, (shared.agg(F.sum("m")).first()[0] or 0) // CROWDED_KEYS)
    # one key that no line has, so that the plan is the same whether there are crowded ones or not
    crowded = shared.where(F.col("m") > limit).select("key").unionByName(lengths.sparkSession.range(1).select(F.lit(0).cast("long").alias("key")))
    crowded = F.broadcast(crowded.distinct().withColumn("many", F.lit(True)))
    within = lambda x, y, n: F.levenshtein(x, y, edits).between(0, F.expr(allowed(n, edits)))

    def told(df: DataFrame, name: str, text: str) -> DataFrame:
        line = F.when(F.col("many"), F.col("line")).alias(text)
        return df.join(crowded, "key", "left").select("key", F.col("id").alias(name), F.col("c").alias(f"c{name}"), line, *(["n"] if text == "y" else []))

    possible = (F.col("a") != F.col("b")) & (_count_difference("ca", "cb") <= 2 * edits)
    near = F.col("x").isNull() | within("x", "y", "n")
    met = told(index, "a", "x").join(told(keys(True), "b", "y"), "key").where(possible & near)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("x").isNotNull().cast("int").alias("known"))
    pairs = written(pairs.groupBy("a", "b").agg(F.max("known").alias("known")))
    open_ = pairs.where("known = 0").select("a", "b")
    x, y = _texts(lines, open_.select(F.explode(F.array("a", "b")).alias("id")))
    longest = F.greatest(F.char_length("x"), F.char_length("y"))
    verified = open_.join(x, "a").join(y, "b").withColumn("n", longest).where(within("x", "y", "n")).select("a", "b")
    return verified.unionByName(pairs.where("known = 1").select("a", "b"))


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, line_no, dropped, class_doc, class_line, links) for every line.

    Lines are duplicates if equal or joined by a chain of pairs within ``edits`` edits and
    one edit for each ten characters of the longer line. The first of a class, by (doc_id,
    line_no), stays and names it. ``links`` counts the other texts within reach. Empty
    lines separate paragraphs and are never dropped. Equal lines are merged before
    anything is compared, and a line of many rows is told back dealt over many tasks.
    """
    lines = split_lines(docs).where("line <> ''")
    distinct = written(sized(lines.select("line").distinct().withColumn("id", F.monotonically_increasing_id())))
    links = written(edit_links(distinct, edits))
    roots = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    linked = written(distinct.join(roots.withColumnRenamed("node", "id"), "id").join(degree.withColumnRenamed("node", "id"), "id").select(_code("line").alias("key"), "root", "links"))
    rows = lines.select("doc_id", "line_no", _code("line").alias("key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "line_no")).alias("first")
    each = written(rows.groupBy("key").agg(first, F.count("*").alias("n")))
    best = each.join(linked, "key").groupBy("root").agg(F.min("first").alias("best"))
    classed = linked.join(best, "root").select("key", "best", "links")
    named = each.join(classed, "key", "left").select("key", F.coalesce("best", "first").alias("best"), F.coalesce("links", F.expr("0L")).alias("links"))
    told = salted_join(rows, named, ["key"], each.select("key", "n"), ["doc_id", "line_no"])
    return told.select(
        "doc_id", "line_no",
        (~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("line_no") == F.col("best.line_no")))).alias("dropped"),
        F.col("best.doc_id").alias("class_doc"), F.col("best.line_no").alias("class_line"), "links",
    )


def _code(line: str) -> Column:
    """128 bits that stand for a line."""
    return F.unhex(F.md5(line))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, n_links, dropped_lines, classes.

    ``dropped_lines`` are line numbers from 0, ascending, joined by commas; ``classes`` has
    for each of them the line that stays, as doc_id:line_no. ``n_links`` adds up the lines'
    links. Repeated rows of a doc_id are one document here. Null doc_ids form one. Null and
    empty texts have no lines that count; empty in, empty out. Very long texts are whole:
    their lines are rows of their own. Other columns are ignored.
    """
    verdict = line_classes(docs, **options)
    name = F.concat_ws(":", F.coalesce(F.col("class_doc").cast("string"), F.lit("null")), F.col("class_line").cast("string"))
    dropped = F.array_sort(F.collect_list(F.when(F.col("dropped"), F.struct("line_no", name.alias("name")))))
    found = verdict.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if("dropped").alias("n_dropped"), F.sum("links").alias("n_links"), dropped.alias("d")
    )
    joined = docs.select("doc_id").distinct().join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.expr("0L")).alias(c)
    text = lambda f: F.coalesce(F.array_join(F.transform("d", f), ","), F.lit(""))
    return joined.select(
        "doc_id", zero("n_lines"), zero("n_dropped"), zero("n_links"),
        text(lambda x: x["line_no"].cast("string")).alias("dropped_lines"), text(lambda x: x["name"]).alias("classes"),
    )


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text): each text without its dropped lines. Texts without a doc_id are one document's, as in :func:`line_dedup`."""
    verdict = line_classes(docs, **options).where("dropped").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.expr("filter(transform(split(coalesce(text, ''), '\\n', -1), (x, i) -> struct(i, x as line)), s -> not array_contains(coalesce(gone, array()), s.i))")
    joined = docs.select("doc_id", "text").join(verdict.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", F.array_join(kept.getField("line"), "\n").alias("text"))
