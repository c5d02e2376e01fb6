"""Packed ids against the JSON vocabulary with its default settings."""

import numpy as np

from fathom.llm import packing
from fathom.llm.common import ready


def test_added_tokens_are_packed_as_the_json_vocabulary_has_them(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "a  <|endoftext|>\n", "a<|endoftext|", "<|ENDOFTEXT|>", "x 你好<|endoftext|>é", "plain", "", None]
    rows = packing.pack_documents(ready(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {k: [] for k in range(len(texts))}
    for r in sorted(rows, key=lambda r: r.start):
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    want = {k: [*t.encode(x or "", add_special_tokens=False).ids, 0] for k, x in enumerate(texts)}
    assert got == want and got[0] == [64, 220, 50256, 275, 0]
    assert all(r.doc_tokens == len(want[r.doc_id]) for r in rows)
