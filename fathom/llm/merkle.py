"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

Sections end at blank lines, paragraphs at line ends, and phrases (the leaves) at punctuation
before white space or after PHRASE characters; no character is left out, so equal roots mean
equal texts. A node's digest is the SHA-256 of its level's number and its children's digests. The
fingerprint is the root and, after a colon, the shortened digests of the tree below: sections end
with `/` and begin with their own digest and `~`, paragraphs are divided by `.` and begin with theirs
and `-`, phrases are divided by `,`.

The likeness of two fingerprints is the Dice share of their distinct leaves and roots, so only
equal texts have likeness 1. changed_branches() descends from two roots into the sections, paragraphs
and phrases that the other tree lacks, and returns these with their code points.

All of it is DataFrame code. A null text is empty; equal texts, and equal rows, have equal
fingerprints; an empty text has likeness 0 to another. A very long text is one row, and the work is in
proportion to its length. The document after another is the next by ascending id (null ids first,
equal ids by text), and after the last comes the first, which in a table of one row is itself. An
empty table gives an empty result. Columns of the input are kept, whatever their names, but for
those named like an output column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import cut, let, maybe_broadcast, running

PHRASE = 80
LEAF_HEX = 8
#: Rows of a range of ids that one window sorts, on average and at most.
RANGE_ROWS = 2000
RANGE_MOST = 8 * RANGE_ROWS
#: Bytes of text that one task of the shuffle by ranges should get.
TASK_BYTES = 32 << 20

SECTION_END = r"(?<=\n\n)"
PARAGRAPH_END = r"(?<=\n)"
#: A phrase: up to the first punctuation and white space, or PHRASE code points.
PHRASE_OF = rf"(?s).{{1,{PHRASE}}}?(?<=[.!?,;:|]\s)|.{{1,{PHRASE}}}"


def _cut_at(s: Column, pattern: str) -> Column:
    return F.filter(F.split(s, pattern, -1), lambda x: x != "")


def _phrases(paragraph: Column) -> Column:
    return F.regexp_extract_all(paragraph, F.lit(PHRASE_OF), F.lit(0))


def _leaf(phrase: Column) -> Column:
    return F.sha2(F.concat(F.lit("0"), phrase), 256)


def _node(level: int, digests: Column) -> Column:
    return F.sha2(F.concat(F.lit(str(level)), F.array_join(digests, "")), 256)


def tree(text: Column) -> Column:
    """array of sections of paragraphs of leaf digests."""
    return F.transform(
        _cut_at(text, SECTION_END),
        lambda section: F.transform(_cut_at(section, PARAGRAPH_END), lambda paragraph: F.transform(_phrases(paragraph), _leaf)),
    )


def fingerprint(leaves: Column) -> Column:
    """root:manifest of a tree."""

    def short(x: Column) -> Column:
        return F.substring(x, 1, LEAF_HEX)

    def paragraph(p: Column) -> Column:
        digest = _node(1, p)
        return F.struct(digest.alias("digest"), F.concat(short(digest), F.lit("-"), F.array_join(F.transform(p, short), ",")).alias("listed"))

    def section(s: Column) -> Column:
        def made(ps: Column) -> Column:
            digest = _node(2, F.transform(ps, lambda p: p["digest"]))
            return F.struct(digest.alias("digest"), F.concat(short(digest), F.lit("~"), F.array_join(F.transform(ps, lambda p: p["listed"]), ".")).alias("listed"))

        return let(F.transform(s, paragraph), made)

    def whole(ss: Column) -> Column:
        return F.concat(_node(3, F.transform(ss, lambda s: s["digest"])), F.lit(":"), F.array_join(F.transform(ss, lambda s: s["listed"]), "/"))

    return let(F.transform(leaves, section), whole)


def root_of(fp: Column) -> Column:
    return F.substring_index(fp, ":", 1)


def likeness(a: Column, b: Column) -> Column:
    """Dice share of the distinct leaves and roots of two fingerprints; 1 for equal roots only."""
    x, y = (F.array_distinct(F.split(F.regexp_replace(F.substring_index(c, ":", -1), "[0-9a-f]+[~-]", ""), "[,./]")) for c in (a, b))
    share = 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y) + 2)
    empty = F.substring_index(a, ":", -1).eqNullSafe("") | F.substring_index(b, ":", -1).eqNullSafe("")
    return F.when(root_of(a) == root_of(b), F.lit(1.0)).when(empty, F.lit(0.0)).otherwise(share)


def _branches(text: Column) -> Column:
    """The tree with places: array of sections (digest, start, end, below), likewise of paragraphs and phrases."""

    def parts(of: Column, base: Column, level: int) -> Column:
        def placed(p: Column) -> Column:
            def made(ends: Column) -> Column:
                def one(x: Column) -> Column:
                    start, end = base + x["end"] - F.length(x["text"]), base + x["end"]
                    place = start.alias("start"), end.alias("end")
                    if level == 0:
                        return F.struct(_leaf(x["text"]).alias("digest"), *place)
                    below = parts(x["text"], start, level - 1)
                    return let(below, lambda k: F.struct(_node(level, F.transform(k, lambda c: c["digest"])).alias("digest"), *place, k.alias("below")))

                return F.transform(F.arrays_zip(p.alias("text"), ends.alias("end")), one)

            return let(running(F.transform(p, F.length), lambda a, b: a + b), made)

        return let(_phrases(of) if level == 0 else _cut_at(of, PARAGRAPH_END if level == 1 else SECTION_END), placed)

    return parts(text, F.lit(0), 2)


def changed_branches(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, side, section, paragraph, start, end): the phrases of either text that the other's tree lacks.

    The two trees are compared level by level: a section that the other tree has is left as it is, and
    only the paragraphs of others are looked at, then only the phrases of paragraphs that no section of
    the other tree holds. side is `before` or `after`; section and paragraph count from 0; start and end
    are code points. Phrases that were only moved within a paragraph, or repeated, are not listed. key must be unique.
    """
    texts = pairs.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.coalesce(F.col(c), F.lit("")).alias("text")) for n, c in (("before", before), ("after", after))])).alias("t"))
    trees = cut(texts.select("key", "t.side", _branches(F.col("t.text")).alias("below")))
    other = F.when(F.col("side") == "before", "after").otherwise("before")
    everything = trees.select("key", other.alias("side"), "below")
    left, places = trees, []
    for level in ("section", "paragraph", "phrase"):
        rows = left.select("key", "side", *places, F.posexplode("below").alias(level, "node")).select("key", "side", *places, level, "node.*")
        everything = everything.select("key", "side", F.explode("below").alias("node")).select("key", "side", "node.*")
        left = rows.join(everything.select("key", "side", "digest"), ["key", "side", "digest"], "left_anti")
        places.append(level)
    return left.select(F.col("key").alias(key), "side", "section", "paragraph", "start", "end")


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    return docs.withColumn(name, fingerprint(tree(F.coalesce(F.col(text_col), F.lit("")))))


def id_ranges(ids: DataFrame, id_col: str) -> tuple[int, DataFrame]:
    """A width that deals ids to ranges of bounded size, and each range with the next one that has rows."""
    span = ids.agg(F.count("*").alias("n"), F.min(id_col).alias("low"), F.max(id_col).alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    width = min(1 << 62, max(1, (high - low + 1) * RANGE_ROWS // max(1, span["n"])))
    while True:
        ranges = cut(ids.groupBy(_range(F.col(id_col), width).alias("range")).count())
        if width == 1 or (ranges.agg(F.max("count")).first()[0] or 0) <= RANGE_MOST:
            break
        width = max(1, width // 16)
    far = F.expr("range div 4096")
    inner = ranges.select("range", far.alias("far")).withColumn("next", F.lead("range").over(Window.partitionBy("far").orderBy("range")))
    outer = ranges.groupBy(far.alias("far")).agg(F.min("range").alias("first"))
    turn = outer.select("far", F.coalesce(F.lead("first").over(Window.orderBy("far")), F.min("first").over(Window.orderBy("far"))).alias("then"))
    return width, cut(inner.join(turn, "far").select("range", F.coalesce("next", "then").alias("next_range")))


def _range(id_: Column, width: int) -> Column:
    """Never null, in name as well: a join then adds no filter, and all readers share one shuffle of the texts."""
    least = F.lit(-(1 << 63)).cast("long")
    return F.coalesce(F.call_function("div", F.coalesce(id_, least), F.lit(width).cast("long")), least)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fp_col: str = "fingerprint") -> DataFrame:
    """docs (id, text, ...) with fp_col, next_text and next_fingerprint; one shuffle of the texts.

    The first row of each range is also dealt, as a guest, to the range before, where it follows the last row.
    """
    docs = docs.drop(fp_col, "next_text", "next_fingerprint")
    width, ranges = id_ranges(docs.select(id_col), id_col)
    n = ranges.count()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    ranged = docs.withColumn("_range", _range(F.col(id_col), width))
    least = ranged.select("_range", F.col(id_col).alias("_id")).groupBy("_range").agg(F.min(F.struct("_id")).alias("_least")).select(F.col("_range").alias("_of"), F.col("_least._id").alias("_id"))
    ends = ranged.join(maybe_broadcast(least, n, 32), (F.col("_range") == F.col("_of")) & F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
    firsts = ends.groupBy("_range").agg(F.min(F.struct(F.col(text_col).alias("text"))).alias("_first"))
    before = ranges.select(F.col("next_range").alias("_range"), F.col("range").alias("_to"))
    guests = firsts.join(before, "_range").select(F.col("_to").alias("_range"), F.col("_first.text").alias(text_col), F.lit(True).alias("_guest"))
    both = with_fingerprints(ranged.withColumn("_guest", F.lit(False)).unionByName(guests, allowMissingColumns=True), text_col, fp_col)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    order = Window.partitionBy("_range").orderBy("_guest", F.col(id_col).asc_nulls_first(), text_col)
    kept = [*docs.columns, fp_col]
    led = both.repartition(parts, "_range").select(*kept, "_guest", F.lead(text_col).over(order).alias("next_text"), F.lead(fp_col).over(order).alias("next_fingerprint"))
    return led.where("not _guest").drop("_guest")


def query(docs: DataFrame) -> DataFrame:
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = with_next(plain).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    edited = with_fingerprints(edited, "edited", "edited_fingerprint")
    return edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
