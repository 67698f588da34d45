"""Small cases for the operators that need no generated tables: brute force, round trips and edge cases."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import (
    kneser_ney,
    learned_partitions,
    mixing,
    ngram_join,
    packing,
    pii,
    quality_rules,
    secrets,
    site_templates,
    token_files,
)
from emberlog.llm.elias_fano import EliasFano
from emberlog.llm.queries import tokenizer_path

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row int, size int, hash int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, lang="en"):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i, t, lang, f"s{i % 3}" if i % 5 else None, len(t or ""), 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


ODD = [None, "", " \n\t ", "one", "one", "a b \U0001f600 c", "x" * 200_000, "7" * 50_000 + "." * 50_000, "word " * 40_000]


@pytest.fixture(scope="module")
def odd(spark):
    docs = documents(spark, ODD)
    repeated = docs.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))
    return docs.union(docs.filter("doc_id = 3")).union(repeated)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


OPERATORS = {
    "pii": pii.find_personal_data,
    "packing": packing.pack_documents,
    "mixing": mixing.mix_sources,
    "mixed": mixing.mixed,
    "secrets": secrets.scan_secrets,
    "redaction": secrets.without_secrets,
    "quality": quality_rules.judge_quality,
    "passing": quality_rules.passing,
    "near duplicates": ngram_join.near_duplicates,
    "without near duplicates": ngram_join.without_near_duplicates,
    "perplexity": lambda d: kneser_ney.judge_perplexity(d, d.select("doc_id", F.lit(1).alias("quality"))),
}
ROW_FOR_ROW = {"pii", "mixing", "secrets", "redaction", "quality", "near duplicates", "perplexity"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    found = OPERATORS[name](odd).collect()
    if name in ROW_FOR_ROW:
        assert len(found) == len(ODD) + 2


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


# -- personal data --------------------------------------------------------------------------------------------------

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _base_spans(text):
    found = []
    for place, (kind, pattern) in enumerate(_BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and _luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(found))


def test_base_spans_of_personal_data(spark):
    pieces = ["a.b@c.d", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "0.0.0.0255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+", "é", "\U0001f600", " ", "-", "_", "12", "a@b.c..d@e.f", "a@b.c_d@e.f", "\n"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    found = {r["doc_id"]: r["base_sha256"] for r in pii.find_personal_data(documents(spark, texts)).collect()}
    expected = {i: hashlib.sha256(_base_spans(t).encode()).hexdigest() for i, t in enumerate(texts)}
    assert found == expected


def test_personal_data_in_context_is_added(spark):
    texts = [f"mail user{i}@host{i}.example.com or call +1 (212) 555-01{i:02d} now" for i in range(40)]
    texts += [f"please call me by phone 212-555-01{i:02d} tonight" for i in range(10)]
    texts += ["release 300.2.3.4 of part no 1234567890123456"] * 10
    found = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark, texts)).collect()}
    assert all(found[i]["spans"].startswith("phone:") for i in range(40, 50))
    assert all(found[i]["spans"] == "" for i in range(50, 60))


# -- token files ----------------------------------------------------------------------------------------------------


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for count in (0, 1, 2, 63, 64, 65, 1000):
        values = np.sort(rng.integers(0, 10**9, count))
        code = EliasFano.encode(values)
        assert code.decode().tolist() == values.tolist()
        assert [code.select(i) for i in range(count)] == values.tolist()
    assert EliasFano.encode(np.arange(100) * 900).bits < 100 * 13
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([2, 1]))


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [*ODD, "It's, DON'T! naïvé क़. <|endoftext|> 'll \x1c x", "Straße, 42% A1. ÉTÉ... ΣΑΣ"]
    token_files.write_token_files(documents(spark, texts), str(tmp_path / "t"), tokenizer_path(), 3)
    found = sorted(token_files.read_token_files(spark, str(tmp_path / "t")).collect())
    tokenizer, start = Tokenizer.from_file(tokenizer_path()), 0
    for row, text in zip(found, texts, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    block = spark.read.parquet(str(tmp_path / "t")).first().asDict()
    code = EliasFano(len(block["doc_ids"]), block["ends_low_bits"], block["ends_low"], block["ends_high"], block["ends_samples"])
    assert [len(token_files.document_ids(block, i)) for i in range(code.count)] == np.diff(np.r_[0, code.decode()]).tolist()


# -- nearest neighbours -----------------------------------------------------------------------------------------------


def test_recall_and_order_of_neighbours(spark):
    rng = np.random.default_rng(2)
    points = (rng.standard_normal((40, 16))[rng.integers(0, 40, 9_000)] * 2 + rng.standard_normal((9_000, 16))).astype("float32")
    points[5_000:5_300] = points[4_000]  # copies
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(9_001, None), (9_002, [0.0] * 16), (9_003, [float("nan")] * 16), (9_004, [None] * 16), (9_100, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in learned_partitions.search(vectors, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(found) == set(range(0, 9_000, 100))
    exact = points.astype(float)
    hits = 0
    for query, rows in found.items():
        assert [r[0] for r in sorted(rows)] == list(range(1, 11))
        assert [r[1:] for r in sorted(rows)] == sorted(r[1:] for r in rows)
        away = np.sqrt(((exact - exact[query]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(9_000), away)) if i != query][:10]
        hits += len(set(best) & {r[2] for r in rows})
    assert hits >= 0.9 * 10 * len(found)


# -- packing ----------------------------------------------------------------------------------------------------------


def test_packing_places_every_token_once(spark):
    rng = random.Random(3)
    texts = [" ".join(["w"] * rng.choice([0, 1, 5, 300, 512, 700, 4096, 9000, rng.randrange(1, 3000)])) for _ in range(200)]
    found = packing.pack_documents(documents(spark, texts)).collect()
    covered = {}
    bins = {}
    for r in found:
        covered.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"]))
        bins.setdefault((r["bin_id"], r["bin_length"], r["bin_used"]), []).append((r["bin_offset"], r["n_tokens"]))
    for i, text in enumerate(texts):
        at = 0
        for start, n in sorted(covered[i]):
            assert start == at
            at += n
        assert at == len(WORD.findall(text))
    for (_, length, used), held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at == used <= length
        assert length == min(x for x in packing.LENGTHS if x >= used)
    assert sum(b[2] for b in bins) / sum(b[1] for b in bins) > 0.9


# -- mixing -------------------------------------------------------------------------------------------------------------


def test_targets_stop_at_twice_the_source():
    targets = mixing.source_targets({"a": 10, "b": 1_000, None: 1_000}, (3, 1, 2), 1.5, 2.0)
    assert targets["a"] == 20 and sum(targets.values()) == pytest.approx(1.5 * 2_010)
    assert targets[None] == pytest.approx(2 * targets["b"])


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    docs = documents(spark, [" ".join(["w"] * rng.randrange(0, 60)) for _ in range(3_000)])
    rows = mixing.mix_sources(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 30
        assert {r["taken"] // r["size"] for r in own if r["size"]} <= {0, 1, 2}
    again = mixing.mix_sources(docs.repartition(7)).select("row.doc_id", "row.source", "size", "source_size", "target", "taken")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows))
    assert mixing.mixed(docs).count() == sum(r["taken"] // r["size"] for r in rows if r["size"]) + sum(
        mixing.mix_sources(docs).filter("size = 0").agg(F.sum("times")).first()
    )


# -- secrets ------------------------------------------------------------------------------------------------------------

SECRET = "api_key = 'ABCDEF123456'"


def _b64(data):
    return base64.b64encode(data).decode()


@pytest.mark.parametrize(
    "hidden",
    [
        quote(SECRET, safe=""),
        quote(quote(SECRET, safe=""), safe=""),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        _b64(SECRET.encode()),
        _b64(gzip.compress(SECRET.encode())),
        _b64(zlib.compress(_b64(gzip.compress(quote(SECRET).encode())).encode())),
    ],
)
def test_secrets_in_layers(hidden):
    text = f"é before {hidden} after"
    base, spans = secrets.find_secrets(text)
    start, end = len("é before "), len("é before ") + len(hidden)
    assert any(kind == "assign" and start <= s < e <= end for kind, s, e in spans)
    assert SECRET not in (secrets.redacted(text) or "") and (secrets.redacted(text) or "").endswith(" after")
    assert set(base) <= set(spans)


_PLAIN = base64.b64encode(SECRET.encode()).decode()
_LONG = " ".join(hashlib.sha256(bytes([i])).hexdigest()[:9] for i in range(40)) + " " + SECRET


@pytest.mark.parametrize(
    "hidden",
    [
        "payload=" + _PLAIN.rstrip("="),
        "http://a.example/?q=" + _PLAIN,
        "/files/" + _PLAIN,
        "/files/" + _PLAIN.rstrip("=") + "/raw-data",
        "ref-" + _PLAIN,
        "some_name_" + _b64(gzip.compress(SECRET.encode(), mtime=0)),
        base64.encodebytes(gzip.compress(_LONG.encode(), mtime=0)).decode().strip(),
        base64.encodebytes(_LONG.encode()).decode().strip().replace("\n", "\r\n"),
        base64.encodebytes(("x" * 45 + SECRET).encode()).decode().strip(),
        "-----BEGIN CERTIFICATE-----\n" + base64.encodebytes(_LONG.encode()).decode() + "-----END CERTIFICATE-----",
    ],
)
def test_encoded_runs_beside_other_characters(hidden):
    text = f"é before {hidden} after"
    start, end = len("é before "), len("é before ") + len(hidden)
    assert any(kind == "assign" and start <= s < e <= end for kind, s, e in secrets.find_secrets(text)[1])
    assert _PLAIN[:20] not in secrets.redacted(text) and secrets.redacted(text).endswith(" after")


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_secrets_in_long_and_repeated_members(pack):
    log = b"an ordinary line of a log\n" * 700_000
    key = SECRET.encode()
    for hidden in (_b64(pack(log + key)), _b64(pack(b"first " * 9) + pack(b"second " * 9 + key)), _b64(pack(pack(log) + pack(key)))):
        base, spans = secrets.find_secrets(f"before {hidden} after")
        assert ("assign", 7, 7 + len(hidden)) in spans


def test_secrets_across_blocks(monkeypatch):
    for name, size in (("BLOCK", 3_000), ("LARGEST_BLOCK", 12_000), ("OVERLAP", 100), ("_STEP", 700)):
        monkeypatch.setattr(secrets, name, size)
    inner = _b64((("é filler " * 90) + SECRET).encode())
    for gap in range(0, 4_000, 37):
        for data in ("é w " * 300 + "x" * gap + " " + SECRET, "y " * gap + inner, "z" * 10 * gap + " " + SECRET):
            hidden = _b64(gzip.compress(data.encode()))
            assert ("assign", 7, 7 + len(hidden)) in secrets.find_secrets(f"before {hidden} after")[1]


def test_secrets_of_the_text_itself():
    text = "PassWord: hunter22 token=abc AKIA" + "A" * 16 + " " + "0f" * 12 + " AKIA1 " + "0f" * 11 + " %zz \\u12"
    base, spans = secrets.find_secrets(text)
    assert [k for k, _, _ in base] == ["assign", "access", "hex"] and base == spans
    assert secrets.find_secrets("ordinary words %41 and Internationalization of everythingelse") == ([], [])


# -- quality ------------------------------------------------------------------------------------------------------------


def _rules(text):
    found = WORD.findall(text)
    windows = list(zip(found, found[1:], found[2:]))
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    duplicate = sum(bool(WORD.search(line)) and line in lines[:i] for i, line in enumerate(lines))
    return sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), duplicate, len(repeated)


def test_rule_counts():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é ", " ", "\n", "#", "|", "c d\n", "\x1c", " "]) for _ in range(rng.randrange(60)))
        data = text.encode()
        assert quality_rules.rule_counts(data, data.split()) == _rules(text)


def test_divergence_rejects_what_is_not_the_language(spark):
    rng = random.Random(7)
    usual = "the of and to in is that for on with as was by".split()
    prose = [" ".join(rng.choice(usual) if rng.random() < 0.5 else "".join(rng.choices("aeiourstln", k=6)) for _ in range(150)) for _ in range(80)]
    soup = [" ".join("".join(rng.choices("#$%&*<>", k=6)) for _ in range(150)), " | ".join("".join(rng.choices("qwxz", k=9)) for _ in range(150))]
    found = {r["doc_id"]: r["kept"] for r in quality_rules.judge_quality(documents(spark, prose + soup)).collect()}
    assert all(found[i] for i in range(80)) and not found[80] and not found[81]
    assert quality_rules.distance(np.array([1, 0]), np.array([0, 1])) == pytest.approx(1.0)


# -- pages ----------------------------------------------------------------------------------------------------------------


def test_main_text(spark):
    deep = "<div>" * 3_000 + "deep text" + "</div>" * 3_000
    pages = [
        (1, "http://a.example/1", "<title>t</title><nav>n</nav><article><header>h</header><h1>A &amp; B</h1><p>x <b>bo</b>ld<br>y</p><div class='comments'>c</div></article><footer>f</footer>"),
        (2, "http://a.example/2", None),
        (3, None, deep),
        (4, "", "<p>a<script>if (a<b) '</p>'</script>b &lt;i&gt;<!-- c --> d<form>q</form>"),
        *((10 + i, f"http://B.example/{i}", f"<body><div>Welcome to this site</div><div><p>story {i} goes on</p></div></body>") for i in range(6)),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit(2))
    found = {r["page_id"]: r["text"] for r in site_templates.extract_main_text(frame).collect()}
    assert found[1] == "A & B x bold y"
    assert (found[2], found[3], found[4]) == ("", "deep text", "ab <i> d")
    assert [found[10 + i] for i in range(6)] == [f"story {i} goes on" for i in range(6)]
    assert site_templates.extract_main_text(frame.limit(0)).collect() == []


def test_templates_of_a_large_host_and_copies_of_pages(spark):
    pages = [(i, f"http://a.example/{i}", f"<body><div class='x{i % 32}'>notice {i % 32}</div><div><p>story {i} goes on</p></div></body>") for i in range(320)]
    pages += [(400 + i, f"http://a.example/p?{i}", "<body><div><p>one page at many addresses</p></div></body>") for i in range(40)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in site_templates.extract_main_text(frame).collect()}
    assert [found[i] for i in range(320)] == [f"story {i} goes on" for i in range(320)]
    assert {found[400 + i] for i in range(40)} == {"one page at many addresses"}


def test_templates_below_any_depth(spark):
    deep = [(i, f"http://a.example/{i}", "<div>" * 5_000 + f"<section>menu of all</section><p>story {i}</p>" + "</div>" * 5_000) for i in range(4)]
    frame = spark.createDataFrame(deep, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in site_templates.extract_main_text(frame).collect()} == {i: f"story {i}" for i in range(4)}


# -- n-gram join ------------------------------------------------------------------------------------------------------------


def _sets(text):
    found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())


def test_join_against_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 6, 9, 14, 30, 80, 200]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [rng.choice(vocabulary).upper()]
            texts.append(" ".join(copy))
        texts.append(f"{passage} {' '.join(rng.choices(vocabulary, k=rng.choice([10, 20, 40])))}")
    sets = [_sets(t) for t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * len(sets[i] | sets[j]) and part[i] != part[j]:
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    found = {r["doc_id"]: r for r in ngram_join.near_duplicates(documents(spark, texts)).collect()}
    assert [found[i]["n_shingles"] for i in range(len(texts))] == list(map(len, sets))
    assert [found[i]["component_id"] for i in range(len(texts))] == part
    kept = sorted(r["doc_id"] for r in ngram_join.without_near_duplicates(documents(spark, texts)).collect())
    assert kept == sorted(set(part))


def test_small_groups_need_no_rare_shingles(spark, monkeypatch):
    """Three texts with one signature in common at least, of which the outer two are not linked with the first of the group."""
    asked = []
    monkeypatch.setattr(ngram_join, "_rare_features", lambda sets, *a, f=ngram_join._rare_features: asked.append(sets.count()) or f(sets, *a))
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for cut in (0, 16, 32):
            texts.append(" ".join([*base[cut:], *(f"w{rng.randrange(10**6)}" for _ in range(cut // 2))]))
    sets, part = [_sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    found = ngram_join.near_duplicates(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r["component_id"] for r in found] == [min(i for i, q in enumerate(part) if q == p) for p in part]
    assert not asked


def test_one_row_of_each_component(spark):
    rng = random.Random(13)
    base = [rng.choices([f"w{i}" for i in range(300)], k=60) for _ in range(6)]
    near = [[*b[:-1], "other"] for b in base]
    rows = [(1, base[0])] * 4 + [(2, near[0])] * 3 + [(None, base[1])] * 4 + [(None, near[1])] * 2 + [(3, base[2]), (None, near[2]), (None, near[2])]
    rows += [(7, base[3]), (7, base[4]), (6, near[4]), (None, base[5]), (8, []), (8, []), (None, [])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1, 1, 1, 1) for i, w in rows], DOCUMENTS).repartition(3)

    sets, part = [_sets(" ".join(w)) for _, w in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    groups = {}
    for i, p in enumerate(part):
        groups.setdefault(p, []).append(i)
    expected = sorted(min((rows[i][0] is None, rows[i][0] or 0) for i in g) for g in groups.values())
    kept = ngram_join.without_near_duplicates(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == expected
    by_set = {frozenset(s): p for s, p in zip(sets, part) if s}
    worded = [by_set[frozenset(_sets(r["text"]))] for r in kept if r["text"]]
    assert len(worded) == len(set(worded)) == len(set(by_set.values()))
    component = {(rows[i][0], " ".join(rows[i][1])): min((rows[j][0] for j in groups[part[i]] if rows[j][0] is not None), default=None) for i in range(len(rows))}
    found = sorted(((r["doc_id"] or -1), (r["component_id"] or -1)) for r in ngram_join.near_duplicates(docs).collect())
    assert found == sorted(((i or -1), (component[i, " ".join(w)] or -1)) for i, w in rows)


def test_join_returns_only_what_is_exact(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join(["y", *base[1:]]), "apart"]
    found = ngram_join.near_duplicates(documents(spark, texts))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert [r["component_id"] for r in found.orderBy("doc_id").collect()] == [0, 0, 0, 3]


def test_any_order_of_signatures_finds_similar_sets():
    rng = np.random.default_rng(9)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        differ = int(rng.integers(0, len(a) // 4 + 1))
        b = np.unique(np.r_[a[differ // 2 :], rng.integers(0, 2**63, differ - differ // 2).astype(np.uint64)])
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 75 * (len(a) + len(b) - shared):
            widespread = np.sort(rng.choice(a, len(a) // 2, replace=False))
            assert np.intersect1d(ngram_join.signatures(a, widespread), ngram_join.signatures(b, widespread)).size


# -- perplexity -------------------------------------------------------------------------------------------------------------


def test_perplexity_against_a_plain_model(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(words[min(int(rng.expovariate(0.1)), 49)] for _ in range(60)) for _ in range(80)]
    docs = documents(spark, texts)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    trusted = {r["doc_id"] for r in labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(kneser_ney.HELD_OUT)) != 0).collect()}
    found = {r["doc_id"]: r["perplexity"] for r in kneser_ney.judge_perplexity(docs, labels).collect()}

    pairs = {}
    for i in trusted:
        tokens = ["<s>", *texts[i].split()]
        for v, w in zip(tokens, tokens[1:]):
            pairs[v, w] = pairs.get((v, w), 0) + 1
    top = kneser_ney._discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)])
    before = {w: sum(x == w for _, x in pairs) for w in words}
    low = kneser_ney._discounts([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)])
    mass, width = len(pairs), kneser_ney._WIDTH

    def p_word(w):
        return (before[w] - low[min(before[w], 3)] + sum(low[min(n, 3)] for n in before.values()) / width) / mass

    def p(v, w):
        own = {x: n for (u, x), n in pairs.items() if u == v}
        if not own:
            return p_word(w)
        total, back = sum(own.values()), sum(top[min(n, 3)] for n in own.values())
        return (max(own.get(w, 0) - top[min(own.get(w, 0), 3)], 0) + back * p_word(w)) / total

    for i in range(0, 80, 7):
        tokens = ["<s>", *texts[i].split()]
        logs = [np.log(p(v, w)) for v, w in zip(tokens, tokens[1:])]
        assert found[i] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-6)


def test_word_hashes_in_pieces(monkeypatch):
    text = "".join(w + " " * (1 + i % 3) for i, w in enumerate(["ab", "c", "é", "x" * 40, "ab", "tab\tline\nend", "c"] * 30)).encode()
    whole = ngram_join.word_hashes(text)
    names = {}
    for word, value in zip(text.split(), whole, strict=True):
        assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)
    for size in (1, 7, 97):
        monkeypatch.setattr(ngram_join, "_PIECE", size)
        assert ngram_join.word_hashes(text).tolist() == whole.tolist()
    assert len(ngram_join.word_hashes(b"")) == len(ngram_join.word_hashes(b" \t\n ")) == 0


def _prose(rng, words, n):
    return " ".join(words[min(int(rng.expovariate(0.02)), len(words) - 1)] for _ in range(n))


def test_junk_and_unseen_words_are_dear(spark):
    rng = random.Random(11)
    syllables = ["ka", "to", "mi", "re", "su", "no", "la", "ve"]
    words = sorted({"".join(rng.choices(syllables, k=rng.randrange(2, 5))) for _ in range(400)})
    good = [_prose(rng, words, 80) for _ in range(150)]
    junk = [" ".join("".join(rng.choices("qwxzjpfgbd", k=8)) for _ in range(80)) for _ in range(5)]
    unseen = [" ".join("".join(rng.choices("bcdfgh", k=6)) for _ in range(80)) for _ in range(5)]
    docs = documents(spark, good + junk + unseen)
    labels = docs.filter("doc_id < 150").select("doc_id", F.lit(1).alias("quality"))
    found = {r["doc_id"]: r for r in kneser_ney.judge_perplexity(docs, labels).collect()}
    assert sum(found[i]["kept"] for i in range(150)) >= 145
    assert not any(found[i]["kept"] for i in range(150, 160))
    assert min(found[i]["perplexity"] for i in range(150, 160)) > max(found[i]["perplexity"] for i in range(150))


def test_spelling_sums_to_one_at_every_context():
    keys, counts = np.unique(kneser_ney._trigrams([b"abc", b"abd", b"ba", b"\xc3\xa9"])[0], return_counts=True)
    spelling = kneser_ney.Spelling(keys, counts)
    for a, b in ((256, 256), (256, ord("a")), (ord("a"), ord("b")), (1, 2)):
        assert spelling._at((a * 257 + b) * 257 + np.arange(257), 3).sum() == pytest.approx(1.0)
    assert spelling.log_prob([b"abc", b"zzz"])[0] > spelling.log_prob([b"zzz"])[0]


def test_small_languages_have_thresholds(spark):
    rng = random.Random(12)
    words = sorted({"".join(rng.choices(["ka", "to", "mi", "re", "su", "no"], k=rng.randrange(2, 5))) for _ in range(200)})
    junk = " ".join("".join(rng.choices("qwxzjpfgbd", k=8)) for _ in range(80))
    rows = []
    for lang, count in (("en", 150), ("fr", 12), (None, 12), ("de", 0)):
        rows += [(_prose(rng, words, 80), lang, 1) for _ in range(count)] + [(junk, lang, 0)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, quality int")
    found = {r["doc_id"]: r for r in kneser_ney.judge_perplexity(docs, docs.select("doc_id", "quality")).collect()}
    for lang, count in (("en", 150), ("fr", 12), (None, 12)):
        own = [i for i, r in enumerate(rows) if r[1] == lang]
        assert all(found[i]["threshold"] is not None for i in own) and not found[own[-1]]["kept"]
        assert sum(found[i]["kept"] for i in own) >= 0.9 * count
    assert found[len(rows) - 1]["threshold"] is None and found[len(rows) - 1]["kept"]
