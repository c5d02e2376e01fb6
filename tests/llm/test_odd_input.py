"""Wide ids, names that clash with the operators' own, patterns that repeat a million times, and whole groups."""

import collections
import random
import time

import numpy as np
import pytest

from fathom.llm import decontaminate, merkle, packing, pii, quality, secret_scan, sharding, url_filter
from fathom.llm.common import fresh, ready


def test_fresh_names():
    assert fresh("_a", ["b", "_A", "__a"]) == "___a" and fresh("_a", []) == "_a"


@pytest.mark.parametrize("ids", [[0, 9 * 10**18], [-(1 << 63), (1 << 63) - 1, 5, 6], [*range(3000), 1 << 62], [random.Random(k).randrange(-(1 << 63), 1 << 63) for k in range(500)]])
def test_fingerprints_of_wide_ids(spark, ids):
    docs = ready(spark).createDataFrame([(i, f"text {i % 97}.") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in merkle.with_next(docs).collect()}
    order = sorted(ids)
    assert got == {a: f"text {b % 97}." for a, b in zip(order, order[1:] + order[:1])}


def test_columns_named_like_temporary_ones_are_kept(spark):
    names = ["_row", "_redrawn", "_base", "_more", "_url", "_hot", "_kept_base", "base", "found", "_k1", "_k2", "_found"]
    schema = "doc_id long, text string, url string, " + ", ".join(f"{n} string" for n in names)
    rows = [(k, f"Mr Smith has token=abcdefabcdef1{k} and a@b.org", f"http://x.com/en/{k}", *(f"{n}{k}" for n in names)) for k in range(4)]
    docs = ready(spark).createDataFrame(rows, schema)
    bench = spark.createDataFrame([("i", "smith has token")], "item_id string, text string")
    listing = url_filter.rules(spark, url_filter.RULES)
    for out, lost in (
        (pii.pseudonymise(docs, b"k"), ()),
        (secret_scan.redact(docs), ()),
        (secret_scan.find_secrets(docs), ("base", "found")),
        (url_filter.judge_urls(docs, listing), ()),
        (decontaminate.find_contamination(docs, bench), ()),
    ):
        got = {r.doc_id: r for r in out.collect()}
        assert sorted(got) == [0, 1, 2, 3]
        for k in got:
            assert all(got[k][n] == f"{n}{k}" for n in names if n not in lost), n


def test_many_items_with_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (20,))
    docs = ready(spark).createDataFrame([(1, "a b c d", "x", "y"), (2, "q", "x", "y")], "doc_id long, text string, _k1 string, _found string")
    bench = spark.createDataFrame([("i", "b c"), ("j", "some other words here"), ("k", "d")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r._k1, r._found) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert got == {1: (3, 2, "x", "y"), 2: (0, 0, "x", "y")}


@pytest.mark.parametrize("pattern", ["( ", "(", "1 ", "1/", "+1 (", "555 0100 ", "a@", "Mr A ", "AB12 ", "王先生", "10.1.2.3 "])
def test_entities_of_a_million_characters(pattern):
    began = time.process_time()
    pii.entities(pattern * (1_000_000 // len(pattern)))
    assert time.process_time() - began < 60


def test_numbers_in_long_runs():
    found = [(k, n) for *_, k, n in pii.entities("( ( ((10.1.2.3) ) (555) 123-4567 .. 1/2/3 4111 1111 1111 1111 ) +1 212 555 0100")]
    assert found == [("ip", "10.1.2.3"), ("phone", "5551234567"), ("card", "4111111111111111"), ("phone", "12125550100")]


def test_windows_of_repeated_words():
    text = "ab " * 300_000
    began = time.process_time()
    scanner = decontaminate.Scanner([("x", text), ("y", "ab cd " * 100_000)], 13)
    assert decontaminate.judge(text, scanner.scan(decontaminate.normalised(text)))[:3] == (300_000, 300_000, 1)
    assert time.process_time() - began < 60


def test_windows_against_brute_force():
    rnd = random.Random(1)
    for k in range(400):
        v = "ab" if k % 2 else "abcdefgh"
        items = [(str(i), " ".join(rnd.choices(v, k=rnd.choice([0, 1, 2, 3, 5, 8, 13, 14, 20, 30])))) for i in range(rnd.randint(0, 6))]
        text = " ".join(rnd.choices(v + "zz", k=rnd.randint(0, 60))) + " " + (items[0][1] if items else "") + " q "
        words, hit, ids = decontaminate.normalised(text), set(), set()
        for i, x in items:
            w = decontaminate.normalised(x)
            s = min(13, len(w))
            for a in range(len(w) - s + 1 if w else 0):
                for b in (b for b in range(len(words) - s + 1) if words[b : b + s] == w[a : a + s]):
                    hit |= set(range(b, b + s))
                    ids.add(i)
        assert decontaminate.judge(text, decontaminate.Scanner(items, 13).scan(words))[:3] == (len(words), len(hit), len(ids))


def test_letters_only_secrets_and_anchored_placeholders(spark):
    texts = {
        "qWxTyUoPLkJhGfDsAzXcVbNmQwErTyUi": True,
        "InternationalizationServiceFactoryBean": False,
        "donaudampfschifffahrtsgesellschaftskapitaen": False,
        "ABSOLUTELYNOTHINGBUTCAPITALS": False,
        "xK9mQ2vR7example3LpZ8nT5w": True,
        "xxxxYourApiKeyHere0123456789": False,
        "placeholder_token_key_here_1234567890": False,
        "sha256=2CF24DBA5FB0A30E26E83B2AC5B9E29E1B161E5C1FA7425E73043362938B9824": False,
        "md5-xK9mQ2vR7_aB3LpZ8nT5wqQ": True,
    }
    docs = ready(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: "entropy" in r.spans for r in secret_scan.query(docs).collect()}
    assert got == dict(enumerate(texts.values()))


def greedy(groups, shards):
    """The placing by a plain loop; groups: (key, bytes, tokens, rows), in the order in which ties are taken."""
    demand = [g[1:] for g in groups]
    total = [sum(d[c] for d in demand) or 1 for c in range(3)]
    unit = [[d[c] / total[c] * sharding.WEIGHTS[c] ** 0.5 for c in range(3)] for d in demand]
    left = [[sum(u[c] for u in unit) / shards for c in range(3)] for _ in range(shards)]
    out = {}
    for i in sorted(range(len(unit)), key=lambda i: -sum(unit[i])):
        scores = [sum(a * b for a, b in zip(r, unit[i])) for r in left]
        best = max(range(shards), key=lambda s: (scores[s], -s))
        left[best] = [a - b for a, b in zip(left[best], unit[i])]
        out[groups[i][0]] = (best, scores)
    return out


def test_groups_stay_whole_and_are_placed_as_by_a_plain_loop(spark, sf):
    docs = ready(spark).read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sharding.query(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    shards = collections.defaultdict(set)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
    total = sum(r.size for r in rows)
    for t, s in shards.items():
        n = list(texts.values()).count(t)
        if max(n / len(rows), n * (len((t or "").encode()) + 1) / total) * 16 * sharding.WHOLE <= 1:
            assert len(s) == 1
    ids = dict(zip(texts, packing.token_ids(list(texts.values()), packing.vocabulary_path())))
    assert all(r.tokens == len(ids[r.doc_id]) // 4 - 1 for r in rows)
    keys = {r.text: r.key for r in docs.selectExpr("text", "xxhash64(text) key").collect()}
    groups = collections.defaultdict(lambda: [0, 0, 0])
    for r in rows:
        g = groups[keys[texts[r.doc_id]]]
        g[0], g[1], g[2] = g[0] + r.size, g[1] + r.tokens, g[2] + 1
    if all(len(s) == 1 for s in shards.values()):  # else pieces, whose sizes this test doesn't know
        ordered = sorted(((k, *v) for k, v in groups.items()), key=lambda g: (g[1], g[0]), reverse=True)
        at = {keys[texts[r.doc_id]]: r.shard for r in rows}
        for k, (best, scores) in greedy(ordered, 16).items():
            assert at[k] == best or scores[at[k]] == pytest.approx(scores[best], abs=1e-12)


def test_the_fit_gets_telling_features_only(spark, sf):
    docs, labels = (ready(spark).read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    grades = {r.doc_id: r.grade for r in quality.graded(labels).collect()}
    reader = quality.Reader()
    rows = [(*reader.features(r.text), grades[r.doc_id]) for r in docs.orderBy("doc_id").collect() if r.doc_id in grades]
    got, want = quality.fit_on(docs, labels), quality.fit(rows)
    assert np.allclose(got.weights, want.weights, atol=1e-4) and np.allclose(got.thresholds, want.thresholds, atol=1e-4)
