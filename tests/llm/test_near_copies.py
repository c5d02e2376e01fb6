"""Near copies that the first round of partners does not join."""

import random

import numpy as np
import pytest

from fathom.llm import near_copies
from fathom.llm.common import ready
from fathom.llm.simhash import fingerprint


def edited(words, count, rnd, name):
    """words with count of them replaced, far enough apart that each changes five shingles."""
    out = list(words)
    for k, at in enumerate(rnd.sample(range(5, len(words) - 5, 6), count)):
        out[at] = f"{name}e{k}"
    return out


def independent_copies():
    """One original in the middle of 300 copies, 0.82 from each; two copies are at 0.67."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(1000)]
    made = {k: edited(words, 20, rnd, f"c{k}x") for k in range(1, 301)}
    made[150] = words
    return made


def chain():
    """Each text is at 0.82 from the next, and under 0.8 from the others."""
    rnd = random.Random(4)
    made = {1: [f"w{i}" for i in range(1000)]}
    for k in range(2, 31):
        made[k] = edited(made[k - 1], 20, rnd, f"s{k}x")
    return made


def shared_passage():
    """200 texts with one passage of half their length, and among them 20 pairs of near copies; ids are dealt."""
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(500)]
    texts = [passage + [f"t{k}x{i}" for i in range(300 + 3 * k)] for k in range(180)]
    texts += [edited(t, 12, rnd, f"n{k}x") for k, t in enumerate(texts[40:60])]
    rnd.shuffle(texts)
    return dict(enumerate(texts, 1))


def brute_force(texts):
    """Groups over all SimHash links and all pairs at 0.8 or more that agree in a band."""
    grams = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in texts.items()}
    fps = {k: fingerprint(" ".join(w)) % (1 << 64) for k, w in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bands = {k: near_copies.sketch(" ".join(w))[2] for k, w in texts.items()}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(grams[a] & grams[b])
            met = any(x == y for x, y in zip(bands[a], bands[b]))
            if met and both >= 0.8 * (len(grams[a]) + len(grams[b]) - both) or (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


@pytest.mark.parametrize("make", [independent_copies, chain, shared_passage])
def test_every_pair_of_a_bucket_counts(spark, monkeypatch, make):
    monkeypatch.setattr(near_copies, "BLOCK", 64, raising=False)
    texts = make()
    want = brute_force(texts)
    docs = ready(spark).createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in near_copies.near_duplicate_groups(docs).collect()}
    assert got == want


def test_common_values(monkeypatch):
    rnd = np.random.default_rng(1)
    a, b = ([np.unique(rnd.integers(0, 300, n).astype("<u4")) for n in rnd.integers(0, 60, m)] for m in (7, 9))
    monkeypatch.setattr(near_copies, "COLUMNS", 16)
    assert near_copies.common_values(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
