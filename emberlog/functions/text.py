"""String helpers with the exact trimming, length and pattern rules of the contract."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.fixed_values import WHITE_SPACE


def trim_white_space(text: Column) -> Column:
    """Strip all Unicode white space; Spark's plain ``trim`` strips U+0020 only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def matches(text: Column, pattern: str) -> Column:
    """Match of the whole string. Java's ``$`` would also match before a final line break."""
    return text.rlike(pattern.removesuffix("$") + r"\z")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units. Pure ASCII, the common case, is answered without re-encoding."""
    wide = (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(wide)


def _symbols(q: str) -> list[tuple[bool, str]]:
    """The characters of ``%q%``, each with whether a backslash before it makes it a plain one."""
    return [(bool(escaped), char) for escaped, char in re.findall(r"(\\)?(.)", f"%{q}%", flags=re.DOTALL)]


def literal_pieces(q: str) -> list[str]:
    """What every text that :func:`contains_pattern` finds has in it, in any letter case: the runs between wildcards."""
    pieces = [""]
    for escaped, char in _symbols(q):
        if char in "%_" and not escaped:
            pieces.append("")
        else:
            pieces[-1] += char
    return [piece for piece in pieces if piece]


def contains_pattern(text: Column, q: str) -> Column:
    """``text ILIKE '%q%'``: ``%``, ``_`` and backslash inside ``q`` stay active on purpose, and a backslash before
    any other character means that character.

    A plain word becomes a substring test. Anything else is matched piece by piece between the ``%``: a piece has a
    fixed length, so its leftmost match is always the right one, and an atomic group says so. Spark's own LIKE would
    try every combination, which takes quadratic time on long texts.
    """
    pieces = [""]
    for escaped, char in _symbols(q):
        if char == "%" and not escaped:
            pieces.append("")
        elif char == "_" and not escaped:
            pieces[-1] += "."
        else:
            pieces[-1] += char if char.isalnum() else "\\" + char
    # The pattern starts with a wildcard; it ends with one unless ``q`` ends in a backslash that turns it literal.
    inner, end = [piece for piece in pieces[1:-1] if piece], pieces[-1]
    folded = F.lower(text)
    if not end and len(inner) == 1 and "." not in inner[0].replace("\\.", ""):
        return F.contains(folded, F.lower(F.lit(re.sub(r"\\(.)", r"\1", inner[0], flags=re.DOTALL))))
    # All the syntax used is lower case already, so the pattern can be folded as a whole, as the text is.
    pattern = "(?s)^" + "".join(f"(?>.*?{piece})" for piece in inner) + (f".*{end}\\z" if end else "")
    return F.rlike(folded, F.lower(F.lit(pattern)))
