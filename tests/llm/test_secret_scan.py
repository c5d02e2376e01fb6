"""All spans of the secret scan against plain code, and very long texts."""

import base64
import collections
import hashlib
import math
import random
import re
import time

from fathom.llm import secret_scan
from fathom.llm.common import ready


def entropy(s, w=secret_scan.WINDOW):
    def bits(x):
        return -sum(n / len(x) * math.log2(n / len(x)) for n in collections.Counter(x).values())

    return max((bits(s[i : i + w]) for i in range(len(s) - w + 1)), default=-1.0)


def suspicious(s):
    if any(re.search(p, s) for p in secret_scan.ALLOWED):
        return False
    limit = next((t for p, t in secret_scan.CLASSES if re.search(p, s)), None)
    if re.search(secret_scan.LETTERS, s):
        turns = len(re.findall("[A-Z](?=[a-z]{1,2}[A-Z])", s))
        limit = secret_scan.LETTERS_BITS if turns >= secret_scan.LETTERS_TURNS else None
    return limit is not None and entropy(s) >= limit - 1e-9


def all_spans(text):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    more = [(m.start(), 3, m.end()) for m in re.finditer(secret_scan.CANDIDATE, text) if suspicious(m[0])]
    found = sorted(base + [x for x in more if not any(b[0] <= x[0] and x[2] <= b[2] for b in base)])
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text):
    out, at = [], 0
    for span in filter(None, all_spans(text).split(",")):
        a, b = map(int, span.split(":")[1:])
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def drawn(rnd):
    """A text of words, secrets of all kinds, harmless strings and odd marks."""
    parts = [
        lambda: rnd.choice(["word", "é😀", "the", "\n", "  ", "secret", "token:", "x=y"]),
        lambda: base64.b64encode(rnd.randbytes(rnd.randint(9, 40))).decode(),
        lambda: rnd.randbytes(rnd.randint(6, 24)).hex(),
        lambda: "AKIA" + "".join(rnd.choices("ABCDEFGHIJ0123456789", k=rnd.randint(10, 20))),
        lambda: f"api_key = '{base64.urlsafe_b64encode(rnd.randbytes(15)).decode()}'",
        lambda: "550e8400-e29b-41d4-a716-446655440000",
        lambda: "well-known-words-joined-by-marks-" + str(rnd.randint(0, 10**6)),
        lambda: "deadbeefdeadbeefdeadbeef/" + base64.b64encode(rnd.randbytes(20)).decode(),
    ]
    return rnd.choice(["", " "]).join(rnd.choice(parts)() for _ in range(rnd.choice([1, 5, 60, 900])))


def test_all_spans_are_those_of_plain_code(spark, sf):
    rnd = random.Random(11)
    texts = [drawn(rnd) for _ in range(60)] + ["", "x"] + [r.text for r in ready(spark).read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.query(docs).collect()}
    assert got == {i: all_spans(t) for i, t in enumerate(texts)}
    assert sum("entropy" in s for s in got.values()) > 20
    assert {r.doc_id: r.text for r in secret_scan.redact(docs).collect()} == {i: redacted(t) for i, t in enumerate(texts)}


def test_very_long_texts_take_time_in_proportion(spark):
    rnd = random.Random(5)
    run = base64.b64encode(rnd.randbytes(300_000)).decode().replace("x", "y").replace("X", "Y")
    digests = " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(20_000))
    docs = ready(spark).createDataFrame([(1, run), (2, digests), (3, "a-" * 200_000)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in secret_scan.query(docs).collect()}
    assert time.time() - began < 90
    assert got[1].spans == "entropy:0:400000" and got[2].n_hex == 20_000 and got[3].spans == ""


def test_input_columns_of_the_same_names_are_kept_by_redaction(spark):
    docs = spark.createDataFrame([("b", "f", "token=abcdefabcdef12"), ("b", "f", None)], "base string, found string, text string")
    assert [tuple(r) for r in secret_scan.redact(docs).collect()] == [("b", "f", "[SECRET]"), ("b", "f", None)]
