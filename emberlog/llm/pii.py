"""Personal data by weak supervision, in DataFrame operations only.

1. *Candidates*: every match of a kind's strict pattern, matches that fail its checks, and matches of looser spellings.
2. *Labelers* vote on each (for +1, against -1, abstain 0): ``regex`` (the strict pattern with its checks), ``gazetteer``
   (lists of top-level domains, calling codes, card ranges, reserved networks), ``context`` (words around it) and
   ``shape`` (what it touches).
3. *Aggregation*: the votes are counted by pattern (a bounded number of rows, see :func:`count_patterns`), and
   expectation-maximisation estimates how reliable each labeler is and how likely each pattern is personal data.
4. *Classifier*: a logistic regression over votes and form, trained on those likelihoods, scores every candidate.

Spans that pass the strict pattern and its checks are always kept; the classifier adds further ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ready
from emberlog.session import materialise

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "shape")

#: Probability from which the classifier adds a span.
ADD_FROM = 0.9

# Strict patterns. Possessive repeats and the guards before them change no match: they only stop the search from trying
# the same stretch again, so that long texts take linear time and no stack.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser spellings.
_EMAIL_WORDS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[A-Za-z0-9-]++)++"
)
_PHONE_LOCAL = r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])"

# Fixed values of the gazetteer and context labelers.
_TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|io|eu|de|fr|es|uk|it|nl|ch|at|be|pt|pl|us|ca|mx|br|au|nz|jp|cn|in|kr|ru|za"
_CALLING_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-3]|85[0-9]|97[0-9]"
_CARD_RANGES = "4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65"
_RESERVED_NETWORKS = "0|127|22[4-9]|23[0-9]|24[0-9]|25[0-9]"
_CONTEXT_FOR = {
    "email": r"e-?mail|contact|write to|reach|courriel|correo|mailto|kontakt",
    "ip": r"\bip\b|address|adresse|server|host|login|client|remote",
    "card": r"card|credit|visa|mastercard|amex|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel\b|\btel[.:]|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono|whatsapp",
}
_CONTEXT_AGAINST = r"version|release|build|isbn|issn|\border\b|invoice|serial|part no|figure|section|chapter|\bdoi\b"

_CANDIDATE = "struct<kind:string,place:int,start:int,end:int,base:boolean,features:array<string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _spans(found: Column, between: Column) -> Column:
    """``array<struct<start, end>>`` in code points, from the matches and the stretches between them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, i: Column) -> Column:
        begin = state["at"] + F.length(F.element_at(between, i))
        end = begin + F.length(F.element_at(found, i))
        span = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(_numbers(found), start, step)["spans"]


def _numbers(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.sequence(F.lit(1), F.size(found))).otherwise(F.array().cast("array<int>"))


def _vote(positive: Column, negative: Column) -> Column:
    return F.when(positive, F.lit(1)).when(negative, F.lit(-1)).otherwise(F.lit(0))


def _gazetteer(kind: str, match: Column) -> Column:
    if kind == "email":
        known = F.lower(match).rlike(rf"(?:\.|dot[\])}}]\x20?|\.\x20)(?:{_TOP_DOMAINS})$")
    elif kind == "ip":
        known = ~match.rlike(rf"^0*(?:{_RESERVED_NETWORKS})\.")
    elif kind == "card":
        known = _digits(match).rlike(rf"^(?:{_CARD_RANGES})")
    else:
        known = match.rlike(rf"^\+(?:{_CALLING_CODES})") | match.rlike(r"^\(?[2-9][0-8][0-9]")
    return _vote(known, ~known)


def _candidates(kind: str, form: str, found: Column, between: Column, spans: Column) -> Column:
    """The kind's candidates of one form: ``strict`` for the base pattern, else a looser one.

    The words around a candidate are 40 characters before it and 20 after it, up to the next match.
    """
    strict = form == "strict"

    def build(i: Column) -> Column:
        match, span = F.element_at(found, i), F.element_at(spans, i)
        left, right = F.right(F.element_at(between, i), F.lit(40)), F.substring(F.element_at(between, i + 1), 1, 20)
        around = F.concat(F.lower(left), F.lit(" \x01 "), F.lower(right))
        n_digits = F.length(_digits(match))
        if not strict:
            passes, considered = F.lit(False), F.lit(True)
        elif kind == "email":
            passes = considered = F.lit(True)
        elif kind == "ip":
            octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
            passes, considered = match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), F.lit(True)
        elif kind == "card":
            considered = n_digits.between(12, 19)
            passes = considered & F.call_function("luhn_check", _digits(match))
        else:
            passes = considered = n_digits.between(9, 15)
        clean = ~left.rlike(r"[\p{L}\p{N}_@/\\=#-]$") & ~right.rlike(r"^[\p{L}\p{N}_@/\\=#-]")
        votes = {
            "regex": _vote(passes, ~passes & F.lit(strict)),
            "gazetteer": _gazetteer(kind, match),
            "context": _vote(around.rlike(_CONTEXT_FOR[kind]), around.rlike(_CONTEXT_AGAINST)),
            "shape": _vote(clean, ~clean),
        }
        length = F.when(n_digits == 0, "none").when(n_digits < 10, "few").when(n_digits < 16, "some").otherwise("many")
        features = [
            *(F.concat(F.lit(f"{name}="), vote.cast("string")) for name, vote in votes.items()),
            F.lit(f"form={form}"),
            F.concat(F.lit("digits="), length),
            F.concat(F.lit("spaced="), match.rlike(r"\x20").cast("string")),
        ]
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(KINDS.index(kind)).alias("place"),
            span["start"].alias("start"),
            span["end"].alias("end"),
            passes.alias("base"),
            F.when(considered, F.array(*features)).alias("features"),
        )

    return F.filter(F.transform(_numbers(found), build), lambda c: c["features"].isNotNull())


def find_candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, candidates)``, one row per row of ``docs``, written to the shared folder.

    A kind's patterns run only where its commonest mark stands in the text.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    some_digit, bracket = text.rlike("[0-9]"), text.contains("[at]") | text.contains("(at)") | text.contains("{at}")
    forms = [
        (text.contains("@"), "email", "strict", _EMAIL),
        (some_digit & text.contains("."), "ip", "strict", _IP),
        (some_digit, "card", "strict", _CARD),
        (text.contains("+"), "phone", "strict", _PHONE),
        (bracket, "email", "words", _EMAIL_WORDS),
        (some_digit, "phone", "local", _PHONE_LOCAL),
    ]
    none = F.array().cast("array<string>")
    # Each step is a projection of its own: its columns are used many times in the next one and must not be inlined.
    matched = plain.select(
        "doc_id",
        *(F.when(there, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"found_{i}") for i, (there, _, _, p) in enumerate(forms)),
        *(F.when(there, F.split(text, p, -1)).otherwise(none).alias(f"between_{i}") for i, (there, _, _, p) in enumerate(forms)),
    )
    placed = matched.select("*", *(_spans(F.col(f"found_{i}"), F.col(f"between_{i}")).alias(f"spans_{i}") for i in range(len(forms))))
    found = [
        _candidates(kind, form, F.col(f"found_{i}"), F.col(f"between_{i}"), F.col(f"spans_{i}")).cast(f"array<{_CANDIDATE}>")
        for i, (_, kind, form, _) in enumerate(forms)
    ]
    return materialise(placed.select("doc_id", F.concat(*found).alias("candidates")), "pii-candidates")


def count_patterns(found: DataFrame) -> list[tuple[str, tuple[str, ...], int]]:
    """``(kind, features, count)``: candidates by what the model sees of them.

    Features have few values, so at most 4 kinds x 3^4 votes x 3 forms x 4 lengths x 2 = 7,776 rows reach the driver,
    whatever the input.
    """
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.features")
    counted = each.groupBy("kind", "features").agg(F.count("*").alias("n"))
    return sorted((r["kind"], tuple(r["features"]), r["n"]) for r in counted.collect())


@dataclass(frozen=True)
class Model:
    """``reliability[kind, labeler, vote] = (P(vote | not personal), P(vote | personal))``; weights of the classifier."""

    reliability: dict[tuple[str, str, int], tuple[float, float]]
    prior: dict[str, float]
    weights: dict[str, float]

    def probability(self, kind: str, features: tuple[str, ...]) -> float:
        return _sigmoid(sum(self.weights.get(f"{kind}:{f}", 0.0) for f in (*features, "bias")))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def _votes(features: tuple[str, ...]) -> dict[str, int]:
    return {name: int(value) for name, value in (f.split("=", 1) for f in features) if name in LABELERS}


#: Pseudo-counts: a labeler is right more often than not until the data say otherwise, the strict one most of all.
_PRIOR_VOTES = {"regex": (20.0, 2.0), "gazetteer": (6.0, 3.0), "context": (6.0, 1.0), "shape": (4.0, 3.0)}


def estimate(patterns: list[tuple[str, tuple[str, ...], int]], rounds: int = 30) -> tuple[dict, dict, dict]:
    """Expectation-maximisation over the vote patterns: reliabilities, priors and each pattern's likelihood."""
    belief = {}
    for kind, features, _ in patterns:
        votes = _votes(features)
        belief[kind, features] = _sigmoid(3.0 * votes["regex"] + votes["gazetteer"] + 2.0 * votes["context"] + 0.5 * votes["shape"] - 0.5)
    reliability: dict[tuple[str, str, int], tuple[float, float]] = {}
    prior: dict[str, float] = {}
    for _ in range(rounds):
        for kind in KINDS:
            own = [(f, n, belief[k, f]) for k, f, n in patterns if k == kind]
            prior[kind] = (sum(n * b for _, n, b in own) + 1) / (sum(n for _, n, _ in own) + 2)
            for labeler in LABELERS:
                right, wrong = _PRIOR_VOTES[labeler]
                against = {-1: right, 0: right, 1: wrong}
                held_for = {-1: wrong, 0: right, 1: right}
                for features, n, b in own:
                    vote = _votes(features)[labeler]
                    against[vote] += n * (1 - b)
                    held_for[vote] += n * b
                for vote in (-1, 0, 1):
                    reliability[kind, labeler, vote] = (against[vote] / sum(against.values()), held_for[vote] / sum(held_for.values()))
        for kind, features, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for labeler, vote in _votes(features).items():
                no, yes = reliability[kind, labeler, vote]
                odds += math.log(yes / no)
            belief[kind, features] = _sigmoid(odds)
    return reliability, prior, belief


def train(patterns: list[tuple[str, tuple[str, ...], int]], rounds: int = 200, ridge: float = 0.01) -> Model:
    """The aggregation, and the classifier fitted to its likelihoods by gradient steps on the pattern counts."""
    reliability, prior, belief = estimate(patterns)
    weights: dict[str, float] = {}
    for kind in KINDS:
        own = [([f"{kind}:{f}" for f in (*features, "bias")], n, belief[kind, features]) for k, features, n in patterns if k == kind]
        total = sum(n for _, n, _ in own)
        weights |= {name: 0.0 for names, _, _ in own for name in names}
        for _ in range(rounds):
            slope = {}
            for names, n, target in own:
                off = n / total * (target - _sigmoid(sum(weights[name] for name in names)))
                for name in names:
                    slope[name] = slope.get(name, 0.0) + off
            for name, s in slope.items():
                weights[name] += 2.0 * (s - ridge * weights[name] / len(slope))
    return Model(reliability, prior, weights)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)``, one row per row of ``docs`` (doc_id, text).

    Counts and digest are of the base spans; ``spans`` has the added ones as well, as ``kind:start:end`` in code points.
    An added span overlaps no base span. Null and empty texts have none. Repeated rows give repeated rows; an empty
    table gives none; further columns are left out.
    """
    ready(docs.sparkSession)
    found = find_candidates(docs)
    model = train(count_patterns(found))
    pairs = [F.lit(x) for item in sorted(model.weights.items()) for x in item]
    weight = F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(0.0))
    least = math.log(ADD_FROM / (1 - ADD_FROM))

    def score(c: Column) -> Column:
        names = F.concat(c["features"], F.array(F.lit("bias")))
        return F.aggregate(
            names,
            F.lit(0.0),
            lambda total, name: total + F.coalesce(F.try_element_at(weight, F.concat(c["kind"], F.lit(":"), name)), F.lit(0.0)),
        )

    def text_of(spans: Column) -> Column:
        in_order = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"], c["place"], c["end"], c["kind"])))
        return F.array_join(F.transform(in_order, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")

    base = F.filter("candidates", lambda c: c["base"])
    other = F.filter("candidates", lambda c: ~c["base"])
    parted = found.select("doc_id", base.alias("base"), other.alias("other"))
    free = F.filter(
        "other",
        lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])) & (score(c) >= F.lit(least)),
    )
    added = parted.select("doc_id", "base", free.alias("added"))

    def count_of(kind: str) -> Column:
        return F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long")

    return added.select(
        "doc_id",
        *(count_of(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(text_of(F.col("base")), 256).alias("base_sha256"),
        text_of(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
