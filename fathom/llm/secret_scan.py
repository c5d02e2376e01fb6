"""Secret scans: patterns, and sliding-window Shannon entropy per character class.

All of it is DataFrame code. The pattern spans (assign, access, hex) are always reported. Other
candidate strings are judged by the greatest entropy of any window of WINDOW characters. The
character counts of the window are kept from step to step (as five-bit fields of a few longs): the
character that leaves is taken off and the one that enters put on, and the sum of c*log2(c) over
the counts, from which the entropy follows, changes by these two. The threshold depends on the
string's character class, and strings that match an allow-list pattern are passed over. Entropy
spans that lie inside a pattern span aren't repeated.

The work is in proportion to a text's length, and to its matches times their number's logarithm:
places come from running sums in doubling steps, not from appending to an array match by match.

Spans are code points, end exclusive. A null text is empty. Every row is judged by itself, with
no shuffle; very long texts, repeated rows, ties and empty tables are plain cases. Columns of the
input that bear the name of an output column are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import fresh, let, running

# The patterns; group 2 of the first is the secret.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LENGTH = 12

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The characters of candidates; a window of at most 31 keeps their counts in five bits each.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
_FIELD, _FIELDS = 5, 12
#: Code points of a piece of a text that is cut up for redaction.
PIECE = 1024
#: Least entropy in bits by class, the first that fits: (pattern, threshold). Others are never flagged.
CLASSES = (
    (r"^[0-9]+$", None),
    (r"^[0-9a-fA-F]+$", 2.9),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", 3.6),
    (r"^(?=.*[0-9].*[0-9])(?=.*[A-Za-z])", 3.5),
)
#: Letters only: the least entropy, and how many upper-case letters must be followed by one or two lower-case ones and an upper-case one again, as words joined in camel case rarely are.
LETTERS, LETTERS_BITS, LETTERS_TURNS = r"^(?=.*[a-z])[A-Za-z]+$", 3.6, 3
#: Harmless shapes: UUIDs, digests that name their kind, words or numbers joined by marks, placeholders.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(?i:sha(1|224|256|384|512)|md5)[-=_](?:[0-9A-Fa-f]+|[A-Za-z0-9+/]+={0,2})$",
    r"^(?=[A-Za-z0-9]+[+/_=-])(?!.*(?:[A-Za-z][0-9]|[0-9][A-Za-z]))",
    r"^(?i:(?>example|placeholder|changeme|change|me|your|my|some|here|key|token|secret|password|api|test|dummy|sample|x{4,}+|0123456789|1234567890|abcdefghij|[-_=+/])++)$",
)


def spans(text: Column, pattern: str, keep: int | None = None, group: int = 0) -> Column:
    """array<struct<start,end,text>> of the leftmost matches; keep: least length of the group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.filter(F.arrays_zip(whole.alias("text"), before.alias("gap")), lambda x: x["text"].isNotNull())

    def placed(r: Column) -> Column:
        ends = running(F.transform(r, lambda x: x["gap"] + F.length(x["text"])), lambda a, b: a + b)
        both = F.arrays_zip(ends.alias("end"), F.transform(r, lambda x: x["text"]).alias("text"))
        return F.transform(both, lambda x: F.struct((x["end"] - F.length(x["text"])).alias("start"), x["end"].alias("end"), x["text"].alias("text")))

    made = let(rows, placed)
    if keep:
        made = F.filter(made, lambda x: F.length(F.regexp_extract(x["text"], pattern, group)) >= keep)
    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")
    return F.when(text.rlike(pattern), made).otherwise(none)


def greatest_entropy(s: Column, window: int = WINDOW) -> Column:
    """The greatest entropy of a window of that many characters of ALPHABET, in bits; -1 for a shorter string."""
    g = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    words = -(-len(ALPHABET) // _FIELDS)
    one = F.lit(1).cast("long")

    def shift(c: Column) -> Column:
        return c % _FIELDS * _FIELD

    def word(c: Column) -> Column:
        return F.floor(c / _FIELDS).cast("int")

    def count(held: Column, c: Column) -> Column:
        return F.call_function("shiftright", F.get(held, word(c)), shift(c)).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def swept(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            comes, goes = F.get(codes, i), F.coalesce(F.get(codes, i - window), F.lit(-1))
            full = goes >= 0
            was = F.when(full, count(acc["held"], goes)).otherwise(F.lit(1))
            now = count(acc["held"], comes) - F.when(comes == goes, F.lit(1)).otherwise(F.lit(0))
            total = acc["sum"] - F.when(full, F.get(g, was) - F.get(g, was - 1)).otherwise(F.lit(0.0)) + F.get(g, now + 1) - F.get(g, now)
            put, taken = F.call_function("shiftleft", one, shift(comes)), F.call_function("shiftleft", one, shift(goes))
            nothing = F.lit(0).cast("long")
            held = F.transform(acc["held"], lambda w, k: w + F.when(k == word(comes), put).otherwise(nothing) - F.when(full & (k == word(goes)), taken).otherwise(nothing))
            bits = F.when(i >= window - 1, math.log2(window) - total / window).otherwise(F.lit(-1.0))
            return F.struct(total.alias("sum"), F.greatest(acc["best"], bits).alias("best"), held.alias("held"))

        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"), F.array_repeat(F.lit(0).cast("long"), words).alias("held"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step)["best"]

    codes = F.transform(F.split(s, ""), lambda c: F.greatest(F.instr(F.lit(ALPHABET), c) - 1, F.lit(0)))
    return F.when(F.length(s) < window, F.lit(-1.0)).otherwise(let(codes, swept))


def suspicious(s: Column) -> Column:
    """Whether a candidate string is random enough for its class and not allow-listed."""
    allowed = reduce(lambda a, b: a | b, [s.rlike(p) for p in ALLOWED])
    limit = F.lit(None).cast("double")
    for pattern, threshold in reversed(CLASSES):
        limit = F.when(s.rlike(pattern), F.lit(threshold).cast("double")).otherwise(limit)
    turns = F.regexp_count(s, F.lit("[A-Z](?=[a-z]{1,2}[A-Z])"))
    limit = F.when(s.rlike(LETTERS), F.when(turns >= LETTERS_TURNS, F.lit(LETTERS_BITS))).otherwise(limit)
    return F.when(allowed | limit.isNull(), F.lit(False)).otherwise(greatest_entropy(s) >= limit)


def _ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["text"].alias("text")))


def _plain(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base and found: array<struct<start,rank,end>> by start and kind (rank in KINDS)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(_ranked(spans(text, ASSIGN, ASSIGN_LENGTH, 2), 0), _ranked(spans(text, ACCESS), 1), _ranked(spans(text, HEX), 2)))
    docs = docs.drop("base", "found")
    first, more = fresh("_base", docs.columns), fresh("_more", docs.columns)
    docs = docs.withColumn(first, base).withColumn(more, _ranked(spans(text, CANDIDATE), 3))

    def outside(all_: Column) -> Column:
        reach = running(F.transform(all_, lambda x: F.when(x["rank"] < 3, x["end"]).otherwise(F.lit(-1))), F.greatest)
        both = F.arrays_zip(all_.alias("span"), reach.alias("reach"))
        kept = F.filter(both, lambda x: F.when(x["span"]["rank"] < 3, F.lit(True)).when(x["reach"] >= x["span"]["end"], F.lit(False)).otherwise(suspicious(x["span"]["text"])))
        return F.transform(kept, lambda x: x["span"])

    # By start and kind, so that all pattern spans which can hold an entropy span stand before it.
    found = F.when(F.size(more) > 0, let(F.array_sort(F.concat(first, more)), outside)).otherwise(F.col(first))
    return docs.withColumn("base", _plain(F.col(first))).withColumn("found", _plain(found)).drop(first, more)


def listed(found: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"], x["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span, or run of overlapping spans, replaced by the mark."""
    text = F.col(text_col)

    def part(pieces: Column, a: Column, b: Column) -> Column:
        """Code points a to b of a text in pieces."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        some = F.transform(F.sequence(first, last), lambda k: F.substring(F.get(pieces, k), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0))))
        return F.when(a < b, F.array_join(some, "")).otherwise(F.lit(""))

    def cleaned(x: Column) -> Column:
        pieces, found, size = x["pieces"], x["found"], x["size"]
        reach = running(F.transform(found, lambda f: f["end"]), F.greatest)

        def joined(r: Column) -> Column:
            before = F.transform(found, lambda f, i: F.struct(F.coalesce(F.get(r, i - 1), F.lit(0)).alias("at"), f["start"].alias("start")))
            fresh = F.filter(before, lambda y: y["start"] >= y["at"])
            marked = F.transform(fresh, lambda y: F.concat(part(pieces, y["at"], y["start"]), F.lit(mark)))
            return F.concat(F.array_join(marked, ""), part(pieces, F.element_at(r, -1), size))

        return let(reach, joined)

    kept = docs.columns
    cut_up = F.struct(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.col("found").alias("found"), F.length(text).alias("size"))
    clean = F.when(F.size("found") > 0, let(cut_up, cleaned)).otherwise(text)
    own = {c: fresh(f"_kept_{c}", kept) for c in kept if c.lower() in ("base", "found") and c != text_col}
    held = find_secrets(docs.withColumnsRenamed(own), text_col)
    return held.withColumn(text_col, clean).select(*[F.col(own.get(c, c)).alias(c) for c in kept])


def query(docs: DataFrame) -> DataFrame:
    def n(rank: int) -> Column:
        return F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")

    found = find_secrets(docs.select("doc_id", "text"))
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"))
