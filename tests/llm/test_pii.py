"""Surrogates against planted entities, whose places and bearers the test knows by itself."""

import collections
import random
import re

import pytest

from fathom.llm import pii
from fathom.llm.common import ready

KEY = b"a test key"
GIVEN = {"f": ["Anna", "Berta", "Clara", "Dora"], "m": ["Adam", "Bruno", "Carl", "David"]}
SURNAMES = ["Smith", "Garcia", "Novak", "Okafor", "Lindqvist", "O'Neil", "Meyer-Lang"]


def planted(n, rnd):
    """Documents with {k} where an entity stands, and the entities: (group, text, pattern that a replacement must match)."""
    emails = [f"{rnd.choice('abcdefgh')}{i}.x@mail{i % 5}.org" for i in range(40)]
    ips = [f"10.{i}.3.{i + 1}" for i in range(30)]
    phones = [f"+1 ({rnd.randint(200, 999)}) 555-{i:04d}" for i in range(30)]
    ssns = [f"{rnd.randint(100, 899)}-12-{i:04d}" for i in range(30)]
    cards = []
    for i in range(30):
        body = f"4{i:014d}"
        cards.append(body + next(c for c in "0123456789" if pii.luhn(body + c)))
    docs, truth = [], []
    for _ in range(n):
        some = [
            ("email", rnd.choice(emails), r"[^@\s]+@[^@\s]+\.(com|net|org)"),
            ("ip", rnd.choice(ips), r"\d+\.\d+\.\d+\.\d+"),
            ("phone", rnd.choice(phones), r"\+1 \(\d{3}\) \d{3}-\d{4}"),
            ("ssn", rnd.choice(ssns), r"\d{3}-\d{2}-\d{4}"),
            ("card", re.sub(r"(?<=\d)(?=(\d{4})+$)", " ", rnd.choice(cards)), r"4\d{3}( \d{4}){3}"),
        ]
        sex = rnd.choice("fm")
        given, last = rnd.choice(GIVEN[sex]), rnd.choice(SURNAMES)
        word = r"[^\W\d_]+"
        people = [(f"name-{sex}", given, word), ("name", last, word), ("name", last, word), (f"name-{sex}", given, word), ("name", last, word)]
        title = {"f": "Mrs.", "m": "Mr."}[sex]
        docs.append((f"Today {title} {{}} {{}} wrote. {{}} has {{}}, {{}} and ({{}}); call {{}} or {{}}. {{}} {{}} paid 1,234 on 2024-01-05.", [*people[:3], *some, *people[3:]]))
        truth.append(docs[-1])
    return docs


def test_planted_entities_get_distinct_consistent_surrogates(spark):
    docs = planted(300, random.Random(4))
    rows = ready(spark).createDataFrame([(i, t.format(*[e[1] for e in es])) for i, (t, es) in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(rows, KEY).collect()}
    stand_ins = collections.defaultdict(set)
    for i, (t, es) in enumerate(docs):
        pattern = re.escape(t.replace("{}", "\x00")).replace("\x00", "(.+?)")
        for e, made in zip(es, re.fullmatch(pattern, got[i].text).groups()):
            assert re.fullmatch(e[2], made) and made != e[1], (e, made)
            stand_ins[e[0].split("-")[0], e[1]].add(made)
        assert got[i].n_entities == len(es)
    assert all(len(s) == 1 for s in stand_ins.values())
    made = [(k[0], *s) for k, s in stand_ins.items()]
    assert len(set(made)) == len(made)
    assert not {m for _, m in made if _ in ("name", "email")} & {o for _, o in stand_ins}


def test_names_are_followed_through_a_document():
    text = "Mr. John Smith met us. Smith said so. John Smith left. Mr Juan Carlos Garcia de la Lopez and Lopez. 昨天王小明先生来了。王小明说好。 Smithy stays."
    out, _ = pii.replace(text, {}, KEY)
    assert not re.search(r"John|Smith\b|Juan|Carlos|Garcia|Lopez|王小明", out) and "Smithy stays." in out and " de la " in out
    words = out.split()
    assert words[2].strip(".,") == words[5].strip(".,") == words[9].strip(".,") and words[1] == words[8]


def test_brackets_around_numbers():
    out, found = pii.replace("(4111111111111111) (10.1.2.3) (988) 555-2485", {}, KEY)
    assert [e[2] for e in found] == ["card", "ip", "phone"] and re.fullmatch(r"\(\d{16}\) \([\d.]+\) \(\d{3}\) \d{3}-\d{4}", out)


@pytest.mark.parametrize("kind,make", [("ssn", lambda i: f"{i:09d}"), ("phone", lambda i: f"{2_000_000_000 + i}"), ("ip", lambda i: f"10.0.{i // 250}.{i % 250}"), ("card", lambda i: f"4{i:015d}"), ("iban", lambda i: f"GB{i % 100:02d}ABCD{i:014d}")])
def test_formats_of_fixed_length_never_collide(kind, make):
    originals = [make(i) for i in range(3000)]
    made = [pii.surrogate(kind, o, 0, KEY) for o in originals]
    assert len(set(made)) == len(made) and all(a != b and len(a) == len(b) or kind == "ip" for a, b in zip(originals, made))


@pytest.mark.parametrize("n", [2, 5, 1000])
def test_the_permutation_moves_every_value(n):
    assert sorted(pii.moved(i, n, KEY, "x") for i in range(n)) == list(range(n)) and all(pii.moved(i, n, KEY, "x") != i for i in range(n))


def test_very_many_han_names_settle(spark):
    a = [chr(0x4E00 + i) for i in range(250)]
    people = ready(spark).createDataFrame([(i, f"Mr. {x}{y} called. {x}{y} left") for i, (x, y) in enumerate((x, y) for x in a for y in a[:200])], "doc_id long, text string")
    out = [r.text.split()[1] for r in pii.pseudonymise(people, KEY).collect()]
    assert len(out) == 50_000 == len(set(out))


def test_odd_rows_and_names(spark):
    long = "x " * 200_000 + "a@b.org"
    docs = ready(spark).createDataFrame([(1, None, "r"), (1, "", "r"), (2, long, None), (2, long, None), (None, "a@b.org", "s")], "doc_id long, text string, row string")
    rows = pii.pseudonymise(docs, KEY).collect()
    assert len(rows) == 5 and sorted(str(r.row) for r in rows) == ["None", "None", "r", "r", "s"]
    assert {r.text[-20:].split()[-1] for r in rows if r.text} == {pii.surrogate("email", "a@b.org", 0, KEY)}
    assert pii.pseudonymise(docs.where("false"), KEY).count() == 0
