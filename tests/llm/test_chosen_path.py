"""The chosen-path join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from emberlog.llm import chosen_path
from emberlog.llm.common import Scratch
from emberlog.llm.graph import smallest_in_component


def word_list(text):
    out = "".join(" " if c in "\t\n\x0b\x0c\r" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in out.split(" ") if w]


def shingle_set(text):
    words = word_list(text)
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(rows):
    """``(doc_id, n, component, kept)`` from the intersections of all sets that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for shingle in s:
            for j in holders[shingle]:
                shared[j] += 1
        for j, n in shared.items():
            if j < i and 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[root(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in ids[root(i)] if x is not None]
        component = (min(known) if known else None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, key long, n long, place string")
    return sorted((tuple(r) for r in chosen_path.near_duplicates(docs).collect()), key=repr)


def random_text(draw, n):
    return [f"w{draw.randrange(3000)}" for _ in range(n)]


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return words


def mixed_rows():
    """Pairs around the threshold, a large cluster of near copies, a passage that many share, exact copies."""
    draw = random.Random(3)
    texts = []
    for n in (20, 60, 150, 400):
        for edits in (1, 2, 3, 4, 6, 8):
            for _ in range(6):
                base = random_text(draw, n)
                texts += [base, edited(draw, base, edits), edited(draw, base, edits)]
    base = random_text(draw, 300)
    texts += [edited(draw, base, draw.choice([1, 2, 3])) for _ in range(250)]
    passage = random_text(draw, 120)
    texts += [passage + random_text(draw, draw.choice([30, 100, 300])) for _ in range(200)]
    texts += [random_text(draw, 80) for _ in range(200)]
    texts += [base] * 100
    texts += [random_text(draw, n) for n in (1, 2, 3, 4, 5, 6)] * 2
    draw.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (5, "ONE"), (6, "a b c d e f"), (None, "a b c d e f"),
    (None, "a\tb\nc d  e F"), (None, "only here without an id"), (None, "only here without an id"), (7, "é É \U0001f600"),
    (8, "word " * 60_000), (9, "x" * 300_000), (-4, "word " * 70_000), (10, " ".join(map(str, range(30_000)))),
    (11, " ".join(map(str, range(29_000)))), (2, "other text for a known id"),
]


def test_against_all_pairs(spark):
    rows = mixed_rows()
    expected, actual = brute(rows), found(spark, rows)
    assert [r[:2] for r in actual] == [r[:2] for r in expected]
    # Nothing is linked that should not be, and at most one in a hundred documents of components is missed.
    group = {r[0]: r[2] for r in expected}
    assert all(group[r[2]] == group[r[0]] for r in actual)
    copies = sum(not r[3] for r in expected)
    missed = sum(not e[3] and a[3] for e, a in zip(expected, actual))
    assert copies > 300 and missed <= copies / 100


def test_links_in_crowded_nodes_are_found(spark):
    """Pairs just above the threshold among texts just below it: their nodes stay large for more tokens than a pair lasts."""
    draw = random.Random(11)
    base, texts = random_text(draw, 200), []
    for _ in range(130):
        one = edited(draw, base, 3)
        texts += [one, edited(draw, one, 3)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    expected = brute(rows)
    assert 20 < sum(not r[3] for r in expected) < 200 and found(spark, rows) == expected


def test_crowded_texts_below_the_threshold_are_hardly_compared(spark, monkeypatch):
    """Sets with a similarity of about two thirds: crowded, but few of them share a shingle that a link of 85 % is met by."""
    draw = random.Random(12)
    base = random_text(draw, 200)
    texts = [edited(draw, base, 4) for _ in range(300)]
    texts += [edited(draw, texts[i], 1) for i in range(0, 300, 30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    asked, write = [], Scratch.write

    def counting(self, df, name):
        table = write(self, df, name)
        if name == "crowded-pairs":
            asked.append(table.count())
        return table

    monkeypatch.setattr(Scratch, "write", counting)
    assert found(spark, rows) == brute(rows)
    assert asked and sum(asked) < 300 * 300 / 2 / 4


@pytest.mark.parametrize("rows", [ODD, [(i, "the same words in all of the rows") for i in range(500)], []])
def test_odd_rows(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_trees_reach_their_recall():
    """Pairs at the threshold in nodes that stay large: the share that still meets after ``DEPTH`` tokens."""
    draw = np.random.default_rng(1)
    met, pairs = 0, 300
    for _ in range(pairs):
        a = draw.integers(0, 1 << 32, chosen_path.POSITIONS, dtype=np.uint32)
        b = np.where(draw.random(chosen_path.POSITIONS) < 0.85, a, a + 1)
        nodes, of = chosen_path.branch(np.tile(chosen_path._ROOTS, 2), np.repeat(np.stack([a, b]), chosen_path.TREES, axis=0), 0, chosen_path.DEPTH)
        met += bool(set(nodes[of < chosen_path.TREES]) & set(nodes[of >= chosen_path.TREES]))
    assert met >= 0.97 * pairs


def test_minwise_tokens_agree_as_often_as_sets_are_alike():
    draw = np.random.default_rng(2)
    agree = []
    for _ in range(100):
        x = draw.integers(0, 1 << 63, 1300, dtype=np.uint64)
        a, b = np.sort(x[:1000]), np.sort(x[300:])
        agree.append((chosen_path.minwise(a) == chosen_path.minwise(b)).mean())
    assert abs(np.mean(agree) - 700 / 1300) < 0.02


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 5), (5, 7), (3, 5), (9, 9), (500, 400), (400, 300), (300, 500)]
    scratch = Scratch(spark)
    table = smallest_in_component(spark.createDataFrame(edges, "u long, v long"), scratch)
    expected = {i: 100 for i in range(100, 161)} | {3: 3, 5: 3, 7: 3} | {300: 300, 400: 300, 500: 300}
    assert dict(map(tuple, table.collect())) == expected and table.count() == len(expected)
    assert smallest_in_component(spark.createDataFrame([], "u long, v long"), scratch).count() == 0
    assert len(scratch.paths) == 2  # the two results
