"""What scoring by perplexity sends, and that the copies of the commonest words and bigrams change no result."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from emberlog.llm import kneser_ney
from emberlog.llm.common import Scratch


def prose(n, seed=21):
    draw = random.Random(seed)
    words = ["".join(draw.choices(["ka", "to", "mi", "Re", "su", "no"], k=draw.randrange(2, 6))) for _ in range(3000)]
    return [" ".join(words[min(int(draw.expovariate(0.004)), 2999)] for _ in range(200)) for _ in range(n)]


def test_a_chunk_sends_a_row_for_each_bucket_not_for_each_word(spark, monkeypatch):
    texts = prose(60)
    trusted = spark.createDataFrame([("en", 0, zstandard.compress(t.encode())) for t in texts], "lang string, fold int, packed binary")
    model = kneser_ney.train(trusted, Scratch(spark))[0]
    monkeypatch.setattr(kneser_ney, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    columns = [pa.array(range(60)), pa.array(["en"] * 60), pa.array([0] * 60, pa.int32()), pa.array([t.encode() for t in texts])]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "fold", "text"])
    assert sum(b.num_rows for b in kneser_ney._sent(iter([batch]), model)) <= 200


def rows(spark, docs, labels):
    return {(r["doc_id"], r["n_words"]): r for r in kneser_ney.judge_perplexity(docs, labels).collect()}


@pytest.mark.parametrize("words, pairs", [(0, 0), (40, 25), (1 << 18, 0)])
def test_copies_change_no_result(spark, monkeypatch, words, pairs):
    texts = [*prose(80), "", None, "zzz " * 7, "ka"]
    docs = spark.createDataFrame([(i if i else None, ("en", "fr", None)[i % 7 % 3], t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    docs = docs.union(docs.filter("doc_id % 9 = 0"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 5 != 0, 1).otherwise(0).alias("quality"))
    whole = rows(spark, docs, labels)
    monkeypatch.setattr(kneser_ney, "COMMONEST", words)
    monkeypatch.setattr(kneser_ney, "COMMONEST_PAIRS", pairs)
    some = rows(spark, docs, labels)
    assert whole.keys() == some.keys()
    for key, r in whole.items():
        assert (r["lang"], r["kept"]) == (some[key]["lang"], some[key]["kept"])
        for name in ("perplexity", "threshold"):
            assert some[key][name] == (None if r[name] is None else pytest.approx(r[name], rel=1e-8))


def test_keys_of_bigrams_give_back_their_ranks():
    draw = np.random.default_rng(3)
    v, w = (draw.integers(0, 1 << 18, 10_000) for _ in range(2))
    keys = kneser_ney._pair_keys(v, w)
    assert [x.tolist() for x in kneser_ney._pair_ranks(keys)] == [v.tolist(), w.tolist()]
    # The highest bits deal neighbouring ranks evenly.
    near = kneser_ney._pair_keys(np.arange(1 << 16) >> 8, np.arange(1 << 16) & 255)
    assert np.bincount((near >> np.uint64(58)).astype(int), minlength=64).max() < 2 * (1 << 16) / 64


def test_ranks_of_words():
    draw = np.random.default_rng(4)
    hashes = np.unique(np.r_[draw.integers(0, 1 << 63, 5000).astype(np.uint64), np.arange(50, dtype=np.uint64)])
    common = kneser_ney.Common(hashes)
    assert common.of(hashes).tolist() == list(range(len(hashes)))
    assert (common.of(np.uint64(60) + np.arange(9, dtype=np.uint64)) == -1).all()
    assert (kneser_ney.Common(hashes[:0]).of(hashes) == -1).all()


def test_pressed_columns_come_back():
    columns = [np.array([1, 5, 1 << 63], np.uint64), np.zeros(0, "<u2"), np.array([-1.5, 2.0])]
    back = kneser_ney._unpressed(kneser_ney._pressed(*columns), "<u8", "<u2", "<f8")
    assert [c.tolist() for c in back] == [c.tolist() for c in columns]
