"""Different texts under one id, or under null ids, all count."""

import collections

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siltstone.llm import packing, suffix_dedup

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_packing_holds_every_text(spark):
    rows = [(None, "no id"), (None, "another text without id"), (5, "one text"), (5, "two other words"), (5, "one text"), (6, None), (6, "six")]
    got = collections.Counter()
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORDS).collect():
        assert r.start == 0 and r.length == r.doc_tokens
        got[r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())] += 1
    t = Tokenizer.from_file(WORDS)
    assert got == {(i, (*t.encode(x or "", add_special_tokens=False).ids, 2)): 1 for i, x in set(rows)}


def test_suffix_dedup_scans_every_text(spark):
    rng = np.random.default_rng(3)
    x, y, z = ("".join(rng.choice(list("abcdefgh "), 150)) for _ in range(3))
    rows = [(None, "N" + x), (None, "M" + y), (None, None), (3, "A" + z + x), (3, "B" + z), (3, "B" + z), (4, "C" + y)]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.kept) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got.keys() == {(None, 151), (3, 301), (3, 151), (4, 151)} and got[4, 151] == (150, b"C")
    assert got[3, 301][0] + got[3, 151][0] == 300
    assert len(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 5
