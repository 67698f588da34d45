"""The divergence of sources against a dense evaluation with whole numbers."""

import re
from collections import Counter, defaultdict

import pytest

from emberlog.llm import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    langs = defaultdict(lambda: defaultdict(Counter))
    documents = defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(SMALL))
        langs[lang or ""][source or ""].update(found)
        documents[lang or ""].update(set(found))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in documents[lang].items() if n >= 10]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares(sum(sources.values(), Counter()))
        for source, counts in sources.items():
            own = shares(counts)
            found = {"pair": {}, "term": {}}
            for other in sources.keys() - {source}:
                q = shares(sources[other])
                found["pair"][other] = sum((own[t] - q[t]) ** 2 // (own[t] + q[t]) for t in kept)
            for t in kept:
                if counts[t] and own[t] > whole[t]:
                    found["term"][t] = (own[t] - whole[t]) ** 2 // (own[t] + whole[t])
            for part, values in found.items():
                ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, t, v, i) for i, (t, v) in enumerate(ranked, 1) if part == "pair" or i <= 10]
    return sorted(out)


def found(spark, rows):
    docs = spark.createDataFrame(
        [(*r, i, 1, 2, "x") for i, r in enumerate(rows)], "text string, lang string, source string, doc_id long, copies long, h1 long, term string"
    )
    return sorted(tuple(r) for r in source_divergence.divergence(docs).collect())


def mixed_rows():
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(5)] + ["straße", "ÉTÉ", "日本", "naïve"]
    rows = []
    for i in range(300):
        text = " ".join(vocabulary[(i * k + k * k // 3) % len(vocabulary)].upper() if k % 4 else vocabulary[(i + k) % 9] for k in range(1, 25))
        rows.append((text + "." * (i % 3), ["en", "de", None][i % 3], ["a", "b", "c", None, "e"][i % 5]))
    return rows


@pytest.mark.parametrize(
    "rows",
    [
        mixed_rows(),
        # One text is a third of all rows and stands in every source; ties; repeated rows.
        mixed_rows()[:120] + [("the same text", "en", f"s{i % 7}") for i in range(150)],
        # Groups without terms, a language that keeps nothing, a source that is alone.
        [(None, "en", "a"), ("", "en", "b"), ("12 34", "en", "c"), ("one", "fr", "a"), ("one", "fr", "b"), ("x " * 50, "it", "z")]
        + [("one two", "en", "d")] * 12,
        [("word " * 100_000 + "a" * 200_000, "en", "a")] * 11 + [("word", "en", "b")],
    ],
)
def test_against_dense_evaluation(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_counts_beyond_64_bits(spark):
    """The product of a count and the scale may exceed a long."""
    held = 5_000_000_000_000
    row = spark.range(1).selectExpr(f"{held}L AS held", f"{3 * held}L AS total").select(source_divergence._share("held", "total").alias("p"))
    assert row.first().p == 1 + 10**9 * (held + 2) // (3 * held)
