"""Text expressions: trimming, tokens with folded accents, n-gram hashes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition begins with an ASCII letter, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """Lower case without accents; letters that don't decompose stay."""
    # translate looks up each character; a text without one of those blocks stays as it is
    return F.lower(F.when(text.rlike("[\u00c0-\u024f]"), F.translate(text, ACCENTED, PLAIN)).otherwise(text))


def search_tokens(text: Column) -> Column:
    """Runs of letters, figures and private-use characters, folded; null texts have none."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def query_tokens(text: Column) -> Column:
    """Tokens of a query before the index splits them again: word characters in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\w]+)"), F.lit(1))


def grams(text: Column, n: int) -> Column:
    """All runs of n characters, found in one pass: each match looks ahead and goes on by a whole character."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))


def hash_bucket(gram: Column, dim: int) -> Column:
    """The first eight bytes of a gram's MD5, modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(gram), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(dim).cast("decimal(20,0)")).cast("int")


def truncated(text: Column, limit: int, mark: str = "\n... (truncated)") -> Column:
    """At most ``limit`` characters, and a mark where something is cut off."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)
