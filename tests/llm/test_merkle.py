"""The Merkle tree, its likeness and its differing branches against plain code."""

import hashlib
import random
import re

import pytest

from fathom.llm import merkle
from fathom.llm.common import ready


def cut_at(s, ends):
    out, at = [], 0
    for e in [*ends, len(s)]:
        if e > at:
            out.append(s[at:e])
            at = e
    return out


def phrases(paragraph):
    """Cut after punctuation and white space; a run of PHRASE characters without a cut is cut as well."""
    ends, at = [], 0
    for i in range(1, len(paragraph) + 1):
        if i >= 2 and paragraph[i - 2] in ".!?,;:|" and paragraph[i - 1] in " \t\n\x0b\f\r" or i - at == merkle.PHRASE:
            ends.append(i)
            at = i
    return cut_at(paragraph, ends)


def sections(text):
    return [cut_at(p, [m.end() for m in re.finditer("\n", p)]) for p in cut_at(text, [i for i in range(2, len(text) + 1) if text[i - 2 : i] == "\n\n"])]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(text):
    """(fingerprint, leaf digests)."""
    tops, listed, leaves = [], [], []
    for section in sections(text):
        ds, ls = [], []
        for paragraph in section:
            own = [sha("0" + x) for x in phrases(paragraph)]
            leaves += [x[:8] for x in own]
            ds.append(sha("1" + "".join(own)))
            ls.append(f"{ds[-1][:8]}-" + ",".join(x[:8] for x in own))
        tops.append(sha("2" + "".join(ds)))
        listed.append(f"{tops[-1][:8]}~" + ".".join(ls))
    return f"{sha('3' + ''.join(tops))}:{'/'.join(listed)}", set(leaves)


def alike(a, b):
    (fa, x), (fb, y) = plain(a), plain(b)
    if fa == fb:
        return 1.0
    return 2 * len(x & y) / (len(x) + len(y) + 2) if x and y else 0.0


def drawn(rnd):
    words = ["alpha", "beta,", "gamma.", "delta!", "é😀", "long" * 30, "a\n", "b.\n\n", "c\n\n\n", "x;"]
    return " ".join(rnd.choices(words, k=rnd.randint(0, 40)))


def test_fingerprints_and_likeness_are_those_of_plain_code(spark, sf):
    rnd = random.Random(2)
    texts = ["", "\n\n", "Alpha beta. Gamma delta. End.", "Gamma delta. Alpha beta. End.", "Alpha beta. Alpha beta. Gamma delta. End.", *(drawn(rnd) for _ in range(80))]
    texts += [r.text or "" for r in ready(spark).read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in merkle.query(docs).collect():
        t, after = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (r.fingerprint, r.edited_fingerprint) == (plain(t)[0], plain(edited)[0])
        assert (r.near_edited, r.near_next) == (pytest.approx(alike(t, edited)), pytest.approx(alike(t, after)))
        assert (r.near_next == 1) == (t == after)


def test_changed_branches_locate_the_edits(spark):
    rnd = random.Random(9)
    rows = [(0, "One. Two.\nThree.\n\nFour.", "One. Two.\nThree!\n\nFour."), (1, None, "New."), (2, "Same.", "Same."), (3, "A. B.\n\nC. D.\n\n", "C. D.\n\nA. B.\n\n")]
    for k in range(4, 60):
        text = drawn(rnd)
        at = rnd.randint(0, len(text))
        rows.append((k, text, text[:at] + rnd.choice(["", " new", "!", "\n\n"]) + text[at + rnd.randint(0, 5) :]))
    got = {tuple(r) for r in merkle.changed_branches(ready(spark).createDataFrame(rows, "k long, a string, b string"), "k", "a", "b").collect()}
    want = set()
    for k, a, b in rows:
        for side, t, o in (("before", a or "", b or ""), ("after", b or "", a or "")):
            other = [[tuple(phrases(p)) for p in s] for s in sections(o)]
            held = {x for s in other for p in s for x in p}
            at = 0
            for i, section in enumerate(sections(t)):
                for j, paragraph in enumerate(section):
                    for x in phrases(paragraph):
                        if [tuple(phrases(p)) for p in section] not in other and tuple(phrases(paragraph)) not in [p for s in other for p in s] and x not in held:
                            want.add((k, side, i, j, at, at + len(x)))
                        at += len(x)
    assert got == want and (0, "after", 0, 1, 10, 17) in got and not any(r[0] in (2, 3) for r in got)


def test_clashing_names_and_long_texts(spark):
    docs = ready(spark).createDataFrame([(1, "a. b.", 77, "x", None), (2, "a " * 300_000, 78, "y", True), (2, "b", 79, "z", False)], "doc_id long, text string, range long, _first string, is_last boolean")
    rows = merkle.with_next(docs).collect()
    assert {(r.doc_id, r.range, r._first, r.is_last) for r in rows} == {(1, 77, "x", None), (2, 78, "y", True), (2, 79, "z", False)}
    assert {r.range: len(r.next_text) for r in rows} == {77: 600_000, 78: 1, 79: 5}
