"""The operators' Python kernels against plain versions."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from fathom.llm import decontaminate, html_text, near_copies, packing, pii, quality, sharding, simhash


def test_token_ids_are_those_of_the_json_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " a", "a  b", "a\nb", "don't 'll x's", "<|endoftext|> a <|endoftext|>", "x y", "　", "a 1234 5,6 !!", "é ñ ü ß", "emoji 😀 😀a", "a\x85b", "tab\tx", "你好 世界", None]
    for text, ids in zip(texts, packing.token_ids(texts, packing.vocabulary_path(), added=True)):
        assert np.frombuffer(ids, "<u4").tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("seed", range(6))
def test_windows_hold_every_token_once_and_are_full(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([1, rnd.randint(1, 1023), 1023]) for _ in range(rnd.choice([1, 2, 40, 300]))]
    made = packing.fill(sizes, 1024)
    loads = [sum(n for _, _, n in w) for w in made]
    assert all(x == 1024 or x & (x - 1) == 0 for x in loads) and max(loads) <= 1024
    pieces = sorted(p for w in made for p in w)
    for i, size in enumerate(sizes):
        at = 0
        for _, start, n in [p for p in pieces if p[0] == i]:
            assert start == at and n > 0
            at += n
        assert at == size


def test_differencing_balances():
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 1000) for _ in range(200)]
    loads = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 20)]
    assert sum(loads) == sum(sizes) and max(loads) - min(loads) < 0.01 * sum(sizes) / 20
    assert packing.differencing([3], 1) == [[0]] and packing.differencing([], 2) == []


def test_placing_is_balanced():
    rnd = np.random.default_rng(0)
    size = rnd.lognormal(7, 1.5, 4000).astype(int) + 1
    demand = np.stack([size, size // 6 + 1, np.ones(4000)], axis=1)
    shard = sharding.place(demand, 16)
    for column in demand.T[:2]:
        loads = np.bincount(shard, weights=column, minlength=16)
        assert loads.max() / loads.min() < 1.02


def plain_simhash(text, k):
    w = text.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    grams = [w[i : i + k] for i in range(len(w) - k + 1)] if len(w) >= k else [w] if w else []
    values = [xxhash.xxh64_intdigest(b" ".join(g), seed=42) for g in grams]
    out = 0
    for bit in range(64):
        if 2 * sum(v >> bit & 1 for v in values) > len(values):
            out |= 1 << bit
    return out


@pytest.mark.parametrize("text", ["", "  ", "one", "One two", "a b c", "The cat sat on the mat. The cat sat.", "é x É y\tz\x0bq " * 50])
def test_fingerprints(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_simhash(text, 3)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 64)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("n", [0, 1, 2, 700, 3000])
def test_leaf_links_are_those_of_all_pairs(n):
    rnd = np.random.default_rng(n)
    centres = rnd.integers(0, 1 << 63, max(1, n // 20), dtype=np.uint64)
    points = centres[rnd.integers(0, len(centres), n)]
    for _ in range(3):
        points = points ^ (np.uint64(1) << rnd.integers(0, 64, n, dtype=np.uint64))
    points = np.unique(points)
    own = np.arange(len(points) // 2)
    queries = np.arange(len(points) // 2, len(points))
    got = simhash.join_leaf(points, own, queries, 3, base=64)
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, own]) <= 3) if n else (own, own)
    want = simhash.least_reachable(i, j, len(points))
    label = {}
    assert all(label.setdefault(a, b) == b for a, b in zip(got.tolist(), want.tolist()))
    assert len(set(got.tolist())) == len(set(want.tolist()))
    across = simhash.join_leaf(points, own, queries, 3, within=False, base=64)
    far = i >= len(own)
    want = simhash.least_reachable(i[far], j[far], len(points))
    assert len(set(across.tolist())) == len(set(want.tolist())) and len({*zip(across.tolist(), want.tolist())}) == len(set(want.tolist()))


@pytest.mark.parametrize("most", [24_000, 150])
def test_cells_are_bounded_and_join_what_all_pairs_join(spark, monkeypatch, most):
    rnd = np.random.default_rng(8)
    points = rnd.integers(0, 1 << 62, 1500)
    points[1000:] = points[:500] ^ (1 << rnd.integers(0, 62, 500))
    real, seen = simhash.cells, []

    def cells(dealt):
        made = real(dealt, most)
        seen.append(made.groupBy("leaf", "a", "b").count().agg(simhash.F.max("count")).first()[0])
        return made

    monkeypatch.setattr(simhash, "cells", cells)
    rows = simhash.ready(spark).createDataFrame(list(enumerate(points.tolist())), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components(rows).collect()}
    i, j = np.nonzero(np.bitwise_count(points.view(np.uint64)[:, None] ^ points.view(np.uint64)[None, :]) <= 3)
    assert [got[k] for k in range(1500)] == simhash.least_reachable(i, j, 1500).tolist()
    assert most > 1000 or seen[0] <= 3 * most


def test_routing_meets_every_close_pair():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 2000, dtype=np.uint64)
    near = base[:300] ^ (np.uint64(1) << rnd.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 300, dtype=np.uint64))
    points = np.concatenate([base, near])
    tree = simhash.grow(points, 12)
    leaves = {}
    for leaf, x, own in simhash.route(points, tree, 3):
        for v in x.tolist():
            leaves.setdefault(v, {})[leaf] = own
    assert all(sum(v.values()) == 1 for v in leaves.values())
    for a, b in zip(base[:300].tolist(), near.tolist()):
        assert any(leaves[a][x] or leaves[b][x] for x in leaves[a].keys() & leaves[b].keys())


def test_likeness_of_sketches():
    words = [f"w{i}" for i in range(200)]
    a = near_copies.sketch(" ".join(words))
    b = near_copies.sketch(" ".join([*words[:190], *[f"x{i}" for i in range(10)]]))
    x = {tuple(words[i : i + 5]) for i in range(196)}
    y = {tuple(([*words[:190], *[f"x{i}" for i in range(10)]])[i : i + 5]) for i in range(196)}
    assert near_copies.likeness(a[1], b[1]) == pytest.approx(len(x & y) / len(x | y))
    assert near_copies.sketch(None) == (0, b"", []) and near_copies.sketch("a")[0] == 1


def judged(text, scanner):
    return decontaminate.judge(text, scanner.scan(decontaminate.normalised(text)))


def test_contamination_by_hand():
    items = [("1", "A b c"), ("2", " ".join(f"q{i}" for i in range(15))), ("3", None), ("4", "!!")]
    scanner = decontaminate.Scanner([(i, t) for i, t in items if t], 13)
    n, hit, k, _, bad, spans = judged("x a  B, c y", scanner)
    assert (n, hit, k, bad) == (5, 3, 1, True) and spans == [{"start": 2, "end": 9}]
    text = " ".join(f"q{i}" for i in range(15))
    assert judged("Z " + text + " z", scanner)[:3] == (17, 15, 1)
    assert judged(" ".join(f"q{i}" for i in range(12)), scanner)[:3] == (12, 0, 0)
    assert judged(None, scanner)[:3] == (0, 0, 0)


def test_contamination_against_all_windows():
    rnd = random.Random(7)
    words = ["a", "b", "é", "c1"]
    items = [(str(i), " ".join(rnd.choices(words, k=rnd.randint(1, 6)))) for i in range(6)]
    scanner = decontaminate.Scanner(items, 4)
    for _ in range(200):
        w = rnd.choices(words, k=rnd.randint(0, 12))
        hit, ids = set(), set()
        for i, t in items:
            g = t.split()
            for p in ([g[j : j + 4] for j in range(len(g) - 3)] if len(g) >= 4 else [g]):
                for j in range(len(w) - len(p) + 1):
                    if w[j : j + len(p)] == p:
                        hit |= set(range(j, j + len(p)))
                        ids.add(i)
        assert judged("  ".join(w), scanner)[:3] == (len(w), len(hit), len(ids))


def test_a_long_shared_passage_is_compared_once():
    words = [f"w{i}" for i in range(60_000)]
    scanner = decontaminate.Scanner([("a", " ".join(words)), ("b", " ".join(words[100:150])), (None, " ".join(words[-13:]))], 13)
    text = " ".join(["x", *words, "y"])
    assert judged(text, scanner)[:3] == (60_002, 60_000, 2)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><!-- x --><div class="ad">buy</div><div id="cookie-notice">cookies</div>
<article><h1>Head &amp; tail</h1><p><b>First  line<br>more<p>Second &lt;x&gt; line.</p><form><input><label>mail</label></form></article>
<aside>side</aside><div class="comments"><p>reader</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & tail\nFirst line more\nSecond <x> line."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div class='nav'>x</div>") == ""
    assert html_text.main_text("plain") == "plain"
    assert html_text.main_text("<p>" * 5000 + "deep" + "<div>" * 5000) == "deep"
    cut = PAGE[: PAGE.index("</article>")]
    assert html_text.main_text(cut).startswith("Head & tail\nFirst")
    wrapped = "<body><div class=wrap><div class=sidebar><p>side things</p></div><div id=content><h1>Title</h1><section><p>First para of a text that is long enough.</section><section><p>Another one, quite long as well.</p></section></div></div></body>"
    assert html_text.main_text(wrapped) == "Title\nFirst para of a text that is long enough.\nAnother one, quite long as well."


def test_surrogates_keep_kind_and_format():
    text = "Mrs. Anna Smith, Dr Smith; ANNA@Foo.org, +1 (988) 555-2485, 42.144.35.254 4041 8949 7460 8795 555-12-3456. Clean 2024-01-05 1,234,567"
    out, found = pii.replace(text, {}, b"k")
    assert [e[2] for e in found] == ["name-f", "name-s", "name-s", "email", "phone", "ip", "card", "ssn"]
    for start, end, *_ in found:
        assert text[start:end] not in out
    assert out.endswith("Clean 2024-01-05 1,234,567") and out == pii.replace(text, {}, b"k")[0] != pii.replace(text, {}, b"l")[0]
    surname = out.split(",")[0].split()[-1]
    assert f"Dr {surname};" in out and surname[0].isupper()
    assert pii.replace(None, {}, b"k") == (None, []) and pii.replace("", {}, b"k") == ("", [])
    for n in range(200):
        card = pii.surrogate("card", "4041894974608795", n, b"k")
        assert pii.luhn(card) == pii.luhn("4041894974608795") and card[0] == "4"


def test_classifier_learns_graded_ratings():
    rnd = random.Random(0)
    rows, texts, reader = [], [], quality.Reader()
    for _ in range(900):
        grade = rnd.choice([0, 1, 2, 2])
        words = rnd.choices([f"w{i}" for i in range(300)], k=60) + ([f"junk{rnd.randrange(4)}"] * 3 if grade == 0 else []) + ([rnd.choice(["idiot", "moron"])] if grade == 1 else [])
        texts.append((" ".join(words), grade))
        rows.append((*reader.features(texts[-1][0]), grade))
    model = quality.fit(rows[:600])
    scorer = quality.Reader(model.weights)
    scores = np.array([scorer.score(t) for t, _ in texts[600:]])
    linear = [float(model.weights[f] @ n) for f, n, _ in rows[600:]]
    assert scores == pytest.approx(linear, abs=1e-4)
    tails = model.tails(scores)
    right = np.mean((tails >= 0.5).sum(axis=1) == [g for _, g in texts[600:]])
    assert right > 0.9 and model.thresholds[0] < model.thresholds[1]
    empty = quality.fit([])
    assert empty.tails(np.zeros(1))[0, -1] > 0.5 and scorer.score(None) == scorer.score("  ") == 0.0


def test_every_token_is_in_one_leaf_of_equal_points():
    assert simhash.grow(np.zeros(10, dtype=np.uint64), 4) == []
    assert [x[0] for x in simhash.route(np.zeros(1, dtype=np.uint64), [], 3)] == [0]
    assert list(itertools.chain(*simhash.shingles(None, 3))) == []
