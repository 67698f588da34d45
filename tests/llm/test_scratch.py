"""What an operator leaves in the shared folder: tables of texts and counts go as soon as they are spent."""

import os
import random

from emberlog.llm import kneser_ney, ngram_join
from emberlog.session import shared_dir


def held(spark):
    folder = f"{shared_dir(spark).removeprefix('file://').rstrip('/')}/emberlog"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def left(spark, run):
    """The result of ``run`` and the names of the tables that it leaves."""
    before = held(spark)
    rows = run().collect()
    return rows, {name.rsplit("-", 1)[0] for name in held(spark) - before}


def texts(n):
    draw = random.Random(5)
    base = [f"w{draw.randrange(300)}" for _ in range(60)]
    return [(i, "en", " ".join(base[: 30 + i % 20] + [f"w{draw.randrange(300)}" for _ in range(20)])) for i in range(n)]


def test_kneser_ney_leaves_no_texts_or_model(spark):
    docs = spark.createDataFrame(texts(60), "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows, names = left(spark, lambda: kneser_ney.judge_perplexity(docs, labels))
    assert len(rows) == 60
    assert not names & {"trusted-texts", "bigrams", "words", "word-levels", "words-and-bigrams"}


def test_ngram_join_leaves_no_texts(spark):
    docs = spark.createDataFrame(texts(60), "doc_id long, lang string, text string")
    rows, names = left(spark, lambda: ngram_join.near_duplicates(docs))
    assert len(rows) == 60
    assert not names & {"candidate-texts", "wanted-texts", "open-texts", "signature-groups", "labels", "rough-pairs"}
