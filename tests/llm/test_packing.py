from __future__ import annotations

import os

import numpy as np
import pytest

from latticework.llm import packing as K
from latticework.llm import tokens

SIZES = "doc_id long, n_tokens long, pack_id int, bin string"


def pack(spark, sizes, caps, **kw):
    s = spark.createDataFrame([(i, n, 9, "x") for i, n in sizes], SIZES)
    return K.pack(s, spark.createDataFrame(caps, "pack_id int, capacity long, size string"), **kw)


def test_everything_is_placed_once_and_fits(spark):
    rng = np.random.default_rng(0)
    sizes = [(i, int(n)) for i, n in enumerate(rng.integers(0, 3000, 500))] + [(500, 0), (501, 1024), (502, None)]
    out = pack(spark, sizes, [(1, 1024, "a"), (2, 4096, "b"), (3, None, "c"), (None, 10, "d"), (4, 0, "e")], group=200).toPandas()
    want = {i: n for i, n in sizes if n}
    for pid, cap in ((1, 1024), (2, 4096)):
        f = out[out.pack_id == pid]
        assert f.groupby("doc_id").n_tokens.sum().to_dict() == want
        assert f.groupby("bin_id").n_tokens.sum().max() <= cap
        assert ((f.groupby("doc_id").size() > 1) == (f.groupby("doc_id").n_tokens.sum() > cap)).all()
        g = f.sort_values(["doc_id", "piece"])
        assert (g.first_token == g.piece * cap).all()
    assert set(out.pack_id) == {1, 2}


def test_the_search_never_loses_bins_and_drains_some():
    rng = np.random.default_rng(1)
    better = 0
    for _ in range(20):
        size = rng.integers(200, 600, 60)
        before = K.best_fit(size, 1000)
        after = K.drain(size, before, 1000)
        assert np.bincount(after, size).max() <= 1000 and after.max() <= before.max()
        better += after.max() < before.max() or (np.bincount(after, size) ** 2).sum() > (np.bincount(before, size) ** 2).sum()
    assert better > 0


def test_one_for_one_and_two_for_one_empty_a_bin():
    size = np.array([7, 2, 6, 3, 2])  # bins of 10: 7+2, 6+3, 2 -> two bins hold all 20
    assert K.drain(size, np.array([0, 0, 1, 1, 2]), 10).max() == 1


def test_report_and_empty_tables(spark):
    caps = spark.createDataFrame([(1, 100)], "pack_id int, capacity long")
    r = K.pack_report(pack(spark, [(1, 250), (2, 50)], [(1, 100, "")]), caps).collect()[0]
    assert (r["n_bins"], r["least_bins"], r["bins_above_least"], r["n_divided"], r["share_used"]) == (3, 3, 0, 1, 1.0)
    assert pack(spark, [], [(1, 100, "")]).collect() == []
    assert pack(spark, [(1, 5)], []).collect() == []
    assert K.pack_report(pack(spark, [], [(1, 100, "")]), caps).collect()[0]["n_bins"] == 0


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")
def test_token_counts(spark):
    import tiktoken

    enc = tokens.encoder(tokens.VOCABULARY)
    plain = tiktoken.Encoding("plain", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=enc._mergeable_ranks, special_tokens={})
    texts = ["It's  a test,\n\n isn't it?  ", "Größe – naïve ¿qué? 12 345", "   ", "\n", "a" * 50, "​ x"]
    for t in texts:
        assert enc.encode_ordinary(t) == plain.encode_ordinary(t)
    long = " ".join(texts) * 3000
    assert tokens.count(long) == len(plain.encode_ordinary(long))
    mixed = "".join(("a", "b ", " c", "  ", "\n", "1", "²", "é", "'s", "!", " ?", "word ", "\xa0")[i * i % 13 - i % 7] for i in range(60_000))
    assert list(tokens.pieces(mixed))[1:] and tokens.count(mixed) == len(plain.encode_ordinary(mixed))
    assert tokens.count("x" * 200_001) > 0
    docs = spark.createDataFrame([(1, "a b", "s"), (2, None, None), (3, "", "s")], "doc_id long, text string, n_tokens string")
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.sizes(docs.drop("n_tokens")).collect()} == {1: 2, 2: 0, 3: 0}
