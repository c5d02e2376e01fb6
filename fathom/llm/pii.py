"""PII surrogates: keyed, type-consistent replacements for the entities found in texts.

Found are e-mail addresses, phone numbers, IPv4 addresses, payment card and bank account numbers,
social security numbers, and names: those at a title, and every later or earlier bare mention of
their words in the same document. Names that never stand at a title are not found. A surrogate keeps
the kind, the format (length, grouping, separators, upper and lower case, check digits where the
original has valid ones) and, for names, the script and the gender that a title in the document
tells. It follows from the caller's secret key and the entity's normal form only, so that all
mentions of an entity, in any document, agree. Names are replaced word by word, so a surname alone
still points to the full name's bearer.

Distinctness: kinds of a fixed length (phone, ip, card, iban, ssn) go through a keyed permutation of
their format's space that moves every value, so they never collide. Names and e-mail addresses are
kept as a table of distinct entities (hot ones are merged before the shuffle), and those whose
surrogates collide with each other's or with an original are drawn again, each time longer, until
none do. Only documents that mention a redrawn entity get its attempt number: the redrawn entities
and the documents' lists are broadcast where their counted rows prove them small.

Null and empty texts stay as they are; a very long text is one row of work. Repeated rows and ties give
equal results. With an empty table nothing is found. Columns n_entities and kinds of the input are
replaced; others, whatever their names, are kept.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import cut, fresh, lookup, maybe_broadcast, ready

#: The query's key. It only makes the query's rows repeatable; a caller of pseudonymise() brings a secret one.
QUERY_KEY = b"key of the registered query, not a secret"

# Titles, and the gender that they tell (f, m, or u for neither).
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Dr": "u", "Prof": "u",
    "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
# Titles that follow a name in Han script, surnames that begin one, and words that join a name's parts.
HAN_TITLES = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "夫人": "f", "博士": "u", "教授": "u", "老师": "u", "老師": "u", "医生": "u", "醫生": "u"}
HAN_SURNAMES = "王李张張刘劉陈陳杨楊黄黃赵趙吴吳周徐孙孫马馬朱胡郭何高林罗羅郑鄭梁谢謝宋唐许許韩韓冯馮邓鄧曹彭曾肖田董袁潘于蒋蔣蔡余杜叶葉程苏蘇魏吕呂丁任沈姚卢盧姜崔"
PARTICLES = frozenset("de del della der den di da do dos das du la le las los van von zu zur ten ter bin ibn al el y e".split())

# Syllables by script, and endings by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti to va ve vi za".split(),
    "cyrillic": "ба бе бо ва ве ви га го да де до за ка ке ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се та те ти то".split(),
    "greek": "βα βε γα γο δα δε ζα θα κα κο λα λε λι μα με μι να νε νι πα πε ρα ρι ρο σα σε τα τε τι".split(),
    "han": "安 白 伯 昌 成 德 東 方 飛 光 國 海 和 華 佳 建 江 景 君 凱 立 林 明 南 寧 平 奇 青 仁 瑞".split(),
}
ENDINGS = {
    "latin": {"f": ["a", "ia", "ina"], "m": ["n", "r", "nd"], "u": ["l", "s", "n"]},
    "cyrillic": {"f": ["а", "ия", "ина"], "m": ["н", "р", "в"], "u": ["л", "с", "н"]},
    "greek": {"f": ["α", "η", "ια"], "m": ["ος", "ης", "ας"], "u": ["ις", "ων", "ος"]},
    "han": {"f": ["麗", "芳", "雪"], "m": ["雄", "剛", "偉"], "u": ["文", "玉", "春"]},
}
DOMAINS = ("example.com", "example.net", "example.org")

_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: A whole run of a number's characters, so that no place is looked at twice.
_NUMBER = re.compile(r"\+?[0-9 ()./-]{7,}+")
_IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_CARD = re.compile(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -]?)\d{6}\2\d{5}")
_PHONE = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?:1[ .-])?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}([.-])\d{3}\1\d{4}|0\d{1,4}[ /-]\d{3,4}[ -]?\d{2,6}")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_TITLE = re.compile(rf"(?<!\w)({'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ \xa0]")
_NAME_WORD = re.compile(r"([^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*)[ \xa0]?")
_NAME_WORDS = 8
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*")
_HAN_NAME = re.compile(rf"([{HAN_SURNAMES}][\u3400-\u9fff]{{1,2}}?)({'|'.join(HAN_TITLES)})")
#: Groups between spaces, and characters, that a number of the formats above has at most.
MOST_PARTS, MOST_CHARS = 7, 64

Entity = tuple[int, int, str, str]  # start, end, kind, normal form


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def number_kind(s: str) -> str | None:
    digits = re.sub(r"\D", "", s)
    if _IP.fullmatch(s):
        return "ip"
    if _SSN.fullmatch(s):
        return "ssn"
    if _CARD.fullmatch(s) and 13 <= len(digits) <= 19:
        return "card"
    if _PHONE.fullmatch(s) and 8 <= len(digits) <= 15:
        return "phone"
    return None


def normal_number(kind: str, s: str) -> str:
    return ".".join(str(int(x)) for x in s.split(".")) if kind == "ip" else re.sub(r"\D", "", s)


def numbers(text: str, at: int, run: str) -> list[Entity]:
    """The entities in a run of digits and marks: at each place the longest sequence of parts that is one."""
    parts = [(at + m.start(), at + m.end()) for m in re.finditer(r"[^ ]+", run)]
    found, i = [], 0
    while i < len(parts):
        for j in range(min(len(parts), i + MOST_PARTS), i, -1):
            a, b = parts[i][0], parts[j - 1][1]
            if b - a > MOST_CHARS:
                continue
            alone = not (a and (text[a - 1].isalnum() or text[a - 1] in "._")) and not (b < len(text) and (text[b].isalnum() or text[b] == "_"))
            # Brackets at the ends may be the number's or the sentence's.
            x, y = b - len(text[a:b].lstrip("(")), a + len(text[a:b].rstrip(")"))
            ends = [(a, b), (max(a, x - 1), y), (x, y)] if (x, y) != (a, b) else [(a, b)]
            if alone and (hit := next(((x, y, kind) for x, y in ends if (kind := number_kind(text[x:y]))), None)):
                found.append((*hit, normal_number(hit[2], text[hit[0] : hit[1]])))
                i = j - 1
                break
        i += 1
    return found


def names(text: str, at: int, gender: str) -> list[Entity]:
    """The capitalised words after a title, which particles may join: given names, and the last one a surname."""
    words = []
    while len(words) < _NAME_WORDS and (m := _NAME_WORD.match(text, at)):
        named = m[1][0].isupper() or script(m[1]) == "han"
        if m[1] in TITLES or not named and not (m[1] in PARTICLES and (after := _NAME_WORD.match(text, m.end())) and (after[1][0].isupper() or after[1] in PARTICLES)):
            break
        if named:
            words.append(m)
        at = m.end()
        if m.end() == m.end(1):
            break
    return [(m.start(1), m.end(1), "name-s" if m is words[-1] else f"name-{gender}", m[1].casefold()) for m in words]


def mentions_of(text: str, titled: list[Entity]) -> list[Entity]:
    """All mentions of the words of titled names; a word's kind is the most telling one of the document."""
    kinds: dict[str, str] = {}
    for _, _, kind, word in titled:
        kinds[word] = max(kinds.get(word, kind), kind, key=lambda k: "sumf".index(k[-1]))
    found = {(a, b): (a, b, kinds[w], w) for a, b, _, w in titled}
    for m in _WORD.finditer(text):
        if m[0][0].isupper() and (kind := kinds.get(w := m[0].casefold())):
            found[m.span()] = (*m.span(), kind, w)
    for w in (w for w in kinds if script(w) == "han"):
        for m in re.finditer(re.escape(w), text):
            found[m.span()] = (*m.span(), kinds[w], w)
    return list(found.values())


def entities(text: str | None) -> list[Entity]:
    """What is found, by place, none overlapping another."""
    if not text:
        return []
    found: list[Entity] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "iban", m[0].replace(" ", "")) for m in _IBAN.finditer(text) if sum(c.isdigit() for c in m[0]) >= 10]
        for m in _NUMBER.finditer(text):
            run = m[0].lstrip(" )./-")
            found += numbers(text, m.end() - len(run), run.rstrip(" ()./-"))
    titled: list[Entity] = []
    if any(t in text for t in TITLES):
        for m in _TITLE.finditer(text):
            titled += names(text, m.end(), TITLES[m[1]])
    if any(t in text for t in HAN_TITLES):
        titled += [(m.start(1), m.end(1), f"name-{HAN_TITLES[m[2]]}", m[1]) for m in _HAN_NAME.finditer(text)]
    if titled:
        found += mentions_of(text, titled)
    found.sort(key=lambda e: (e[0], -e[1]))
    out: list[Entity] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "han" if 0x3400 <= c < 0xA000 else "latin"


class Stream:
    """Keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.block, self.pool = key, "\x1f".join(map(str, what)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.what + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def like(self, s: str) -> str:
        """Letters for letters and digits for digits."""
        out = []
        for c in s:
            if "0" <= c <= "9":
                out.append(str(self.below(10)))
            elif c.isalpha():
                x = chr(97 + self.below(26))
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def moved(x: int, n: int, key: bytes, what: str) -> int:
    """A keyed permutation of 0 to n-1 without fixed points: a Feistel cipher walked until inside, one step on, and back."""
    if n < 2:
        return x
    half = ((n - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    secret = hashlib.sha256(key + b"\x1f" + what.encode()).digest()

    def mixed(i: int, r: int) -> int:
        return int.from_bytes(hashlib.blake2b(r.to_bytes((half + 7) // 8, "big"), key=secret, salt=bytes([i]), digest_size=(half + 7) // 8).digest(), "big") & mask

    def walk(x: int, rounds: range, back: bool) -> int:
        while True:
            a, b = x >> half, x & mask
            for i in rounds:
                a, b = (b ^ mixed(i, a), a) if back else (b, a ^ mixed(i, b))
            x = a << half | b
            if x < n:
                return x

    return walk((walk(x, range(6), False) + 1) % n, range(5, -1, -1), True)


def moved_digits(s: str, key: bytes, what: str) -> str:
    return str(moved(int(s), 10 ** len(s), key, f"{what}{len(s)}")).zfill(len(s)) if s else s


def surrogate(kind: str, normal: str, attempt: int, key: bytes) -> str:
    """The normal form of the replacement."""
    if kind == "ip":
        x = moved(int.from_bytes(bytes(map(int, normal.split("."))), "big"), 1 << 32, key, kind)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "ssn":
        return moved_digits(normal, key, kind)
    if kind == "card":
        def check(body: str) -> int:
            return next(c for c in range(10) if luhn(f"{body}{c}"))

        body = normal[0] + moved_digits(normal[1:-1], key, kind)
        return f"{body}{(check(body) + int(normal[-1]) - check(normal[:-1])) % 10}"
    if kind == "phone":
        tail = normal[-10:]
        if tail[0] < "2":
            return normal[: -len(tail)] + tail[0] + moved_digits(tail[1:], key, "line")
        x = moved(int(tail) - 2 * 10 ** (len(tail) - 1), 8 * 10 ** (len(tail) - 1), key, f"phone{len(tail)}")
        return f"{normal[: -len(tail)]}{x + 2 * 10 ** (len(tail) - 1)}"
    if kind == "iban":
        radix = [10 if c.isdigit() else 26 for c in normal[4:]]
        x = 0
        for c, r in zip(normal[4:], radix):
            x = x * r + (int(c) if r == 10 else ord(c) - 65)
        x = moved(x, math.prod(radix), key, "".join("d" if r == 10 else "a" for r in radix))
        body = []
        for r in reversed(radix):
            x, c = divmod(x, r)
            body.append(str(c) if r == 10 else chr(65 + c))

        def check(body: str) -> int:
            return 98 - int("".join(str(int(c, 36)) for c in f"{body}{normal[:2]}00")) % 97

        text = "".join(reversed(body))
        return f"{normal[:2]}{(check(text) + int(normal[2:4]) - check(normal[4:])) % 100:02d}{text}"
    s = Stream(key, kind, normal, attempt)
    if kind == "email":
        local, _, domain = normal.partition("@")
        labels = domain.split(".")
        inner = Stream(key, "domain", domain)
        hosts = ".".join([*(inner.like(x) for x in labels[:-2]), DOMAINS[inner.below(3)]])
        return f"{s.like(local)}{''.join(chr(97 + s.below(26)) for _ in range(attempt + max(0, 4 - len(local))))}@{hosts}"
    writing = script(normal)
    parts = SYLLABLES[writing]
    n = (1 if writing == "han" else 2) + s.below(2) + attempt
    gender = kind[-1] if kind[-1] in "fm" else "u"
    endings = ENDINGS[writing][gender]
    return "".join(parts[s.below(len(parts))] for _ in range(n)) + endings[s.below(len(endings))]


def written(original: str, kind: str, normal: str) -> str:
    """A replacement's normal form in the original's format."""
    if kind in ("card", "phone", "ssn", "iban"):
        rest = iter(normal)
        return "".join(next(rest) if c.isalnum() else c for c in original)
    if kind.startswith("name"):
        return normal.upper() if original.isupper() and len(original) > 1 else normal[0].upper() + normal[1:]
    return normal.upper() if kind == "email" and original.isupper() else normal


def replace(text: str | None, attempts: dict[tuple[str, str], int], key: bytes) -> tuple[str | None, list[Entity]]:
    found = entities(text)
    if not found:
        return text, found
    out, at = [], 0
    for start, end, kind, normal in found:
        out += [text[at:start], written(text[start:end], kind, surrogate(kind, normal, attempts.get((kind, normal), 0), key))]
        at = end
    return "".join(out) + text[at:], found


def distinct_entities(docs: DataFrame) -> DataFrame:
    """(row, kind, normal) of docs (row, text), once for each row and entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, k, n) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, n in sorted({e[2:] for e in entities(t)})]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int64()), pa.array([r[1] for r in rows], type=pa.string()), pa.array([r[2] for r in rows], type=pa.string())], names=["row", "kind", "normal"])

    return docs.select("row", "text").mapInArrow(run, "row long, kind string, normal string")


def draw(entity: DataFrame, key: bytes) -> DataFrame:
    """entity (kind, normal, attempt) with its surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [surrogate(k, n, a, key) for k, n, a in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, type=pa.string())], names=[*b.schema.names, "surrogate"])

    return entity.select("kind", "normal", "attempt").mapInArrow(run, "kind string, normal string, attempt int, surrogate string")


def settle(entity: DataFrame, key: bytes) -> DataFrame:
    """Draws until all surrogates of a family (names are one) are distinct and none is an original."""
    family = F.regexp_extract("kind", "^[a-z]+", 0)
    drawn = cut(draw(entity.withColumn("attempt", F.lit(0)), key))
    while True:
        named = drawn.withColumn("family", family)
        taken = named.groupBy("family", F.col("surrogate")).agg(F.min(F.struct("kind", "normal")).alias("holder"), F.count("*").alias("n")).where("n > 1")
        twice = named.join(taken, ["family", "surrogate"]).where(F.struct("kind", "normal") != F.col("holder")).select("kind", "normal")
        originals = named.select("family", F.col("normal").alias("surrogate")).distinct()
        same = named.join(originals, ["family", "surrogate"], "left_semi").select("kind", "normal")
        lost = cut(twice.unionByName(same).distinct())
        if lost.isEmpty():
            return drawn
        again = draw(drawn.join(lost, ["kind", "normal"], "left_semi").withColumn("attempt", F.col("attempt") + 1), key)
        drawn = cut(drawn.join(lost, ["kind", "normal"], "left_anti").unionByName(again))


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with the entities of the text replaced, n_entities, and the kinds found."""
    ready(docs.sparkSession)
    docs = docs.drop("n_entities", "kinds")
    columns = docs.columns
    row, again = fresh("_row", columns), fresh("_redrawn", columns)
    rowed = docs.withColumn(row, F.xxhash64(*[c for c in ("doc_id", text_col) if c in docs.columns]))
    mentions = cut(distinct_entities(rowed.select(F.col(row).alias("row"), F.col(text_col).alias("text"))))
    settled = settle(mentions.where("kind = 'email' or kind like 'name-%'").select("kind", "normal").distinct(), key)
    redrawn = cut(settled.where("attempt > 0").select(F.concat_ws("\x1f", "kind", "normal").alias("entity"), "kind", "normal", "attempt"))
    n = redrawn.count()
    if n == 0:
        held = rowed.withColumn(again, F.lit(None).cast("array<struct<kind:string,normal:string,attempt:int>>"))
    else:
        asked = mentions.select("row", F.concat_ws("\x1f", "kind", "normal").alias("entity"))
        counted = redrawn.join(asked.groupBy("entity").agg(F.count("*").alias("times")), "entity")
        met = lookup(asked, counted, "entity", n, 256, "times", mentions.count()).where("attempt is not null")
        lists = cut(met.distinct().groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("kind", "normal", "attempt")).alias(again)))
        held = rowed.join(maybe_broadcast(lists, lists.count(), 512), row, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            done = [replace(t, {(x["kind"], x["normal"]): x["attempt"] for x in r or ()}, key) for t, r in zip(texts, b.column(again).to_pylist())]
            made = {text_col: pa.array([d[0] for d in done], type=pa.string())}
            kept = [made.get(c, b.column(c)) for c in columns]
            n = pa.array([len(d[1]) for d in done], type=pa.int32())
            kinds = pa.array([",".join(sorted({e[2].split("-")[0] for e in d[1]})) for d in done], type=pa.string())
            yield pa.RecordBatch.from_arrays([*kept, n, kinds], names=[*columns, "n_entities", "kinds"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_entities", T.IntegerType()), T.StructField("kinds", T.StringType())])
    return held.select(*docs.columns, again).mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return pseudonymise(docs.select("doc_id", "text"), QUERY_KEY)
