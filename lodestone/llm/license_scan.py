"""License scans: phrases at word positions, and an exact set-similarity join of text blocks with license templates.

A text block is a run of words a quarter longer than the template. It meets the template if it holds ``threshold`` of the
template's different tokens: ``need`` of n. Tokens are ordered by how many rows hold them, rarest first, over all rows. A block
that meets holds one of the template's first n - need + 1 tokens in that order, its prefix; an index from these tokens to
templates is joined with the rows that hold them (prefix filter). A row then needs ``need`` of the template's tokens (length
filter), and where its first one of the prefix stands at place p of the template's n and q of the row's own m known tokens
in order, no more than n - p and m - q tokens can be shared (positional filter). In what passes, the blocks that hold a
token of the prefix are counted exactly.

Every template that a row's blocks meet gives a label: its own if one of these blocks holds half of its ``names`` or more, the
words that tell one license from another, else ``other``. Notices that are too short for a similarity are phrases, and stand whole.

All of it is DataFrame functions, and the plan is the same for any number of templates. Words are cut twice: to count
tokens, and to find the rows in reach, whose texts alone are kept beside the base counts in the shared folder. The driver
gets a row for each token of the templates at most.

Words are runs of a-z (A-Z lower-cased), 0-9 and characters beyond ASCII. Defined cases: a null text counts as empty;
without a match the labels are empty, the positions null and the score 0. Repeated rows are scanned each; ids may be of
any type, null or repeated; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Phrases and labels of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices and their labels, found as phrases too.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0", "licensed under cc by nc 4 0": "cc-by-nc", "licensed under cc by sa 4 0": "cc-by-sa", "gnu general public license version 3": "gpl-3.0",
}


@dataclass(frozen=True)
class Notice:
    """A notice under which works are released, and its names. Several of one label may be given."""

    label: str
    names: str
    text: str


TEMPLATES = (
    Notice("gpl", "gnu general public", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Notice("gpl-3.0", "gnu general public", "this work is licensed under the gnu general public license version 3"),
    Notice("apache-2.0", "apache", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Notice("mit", "granted restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Notice("bsd", "redistribution permitted", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Notice("cc-by-nc", "creative commons noncommercial", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    Notice("cc-by-sa", "creative commons sharealike", "licensed under a creative commons attribution sharealike 4.0 international license"),
    Notice("cc0", "waived copyright", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Notice("mpl", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    Notice("reserved", "reserved reproduced", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
)
#: The label of a block that lacks most of the names.
OTHER = "other"
#: The contract's words, with A-Z taken in before they are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The only letter beyond ASCII whose lower case is an ASCII letter alone, and another that stays beyond.
KELVIN, ANGSTROM = "K", "Å"


def _words(text: Column) -> Column:
    """Words in lower case; within ASCII this is A-Z only."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit(KELVIN), F.lit(ANGSTROM))), F.lit(WORD), F.lit(0))


def _split(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def token_frequencies(held: DataFrame) -> dict[str, int]:
    """In how many rows each token stands (``held`` has a row's different tokens in a column of that name)."""
    return {r["token"]: r["count"] for r in held.select(F.explode("held").alias("token")).groupBy("token").count().collect()}


class _Template:
    """A notice's tokens with what a block needs: how many tokens, how many names, in how many words."""

    def __init__(self, notice: Notice, threshold: float):
        words = _split(notice.text)
        self.label, self.names, self.tokens = notice.label, sorted(set(_split(notice.names))), set(words)
        self.need = max(1, math.ceil(threshold * len(self.tokens) - 1e-9))
        self.named = (len(self.names) + 1) // 2
        self.width = len(words) + len(words) // 4


#: A row of the template table; tokens are in the order of all rows, rarest first.
TEMPLATE = "token string, tid int, label string, tokens array<string>, names array<string>, need int, named int, width int"


def _index(spark: SparkSession, each: Sequence[_Template], counts: Mapping[str, int]) -> tuple[DataFrame, list[str]]:
    """The template table with a row for each token of a prefix, and all these tokens."""
    rows = []
    for k, t in enumerate(each):
        mine = sorted(t.tokens, key=lambda x: (counts.get(x, 0), x))
        rows += [(token, k, t.label, mine, t.names, t.need, t.named, t.width) for token in mine[: len(mine) - t.need + 1]]
    return spark.createDataFrame(rows, TEMPLATE), sorted({r[0] for r in rows})


def _met(rows: DataFrame, index: DataFrame, order: list[str]) -> DataFrame:
    """rid, label, score of the templates that blocks of ``rows`` (rid, held, hits, text) meet.

    ``held`` are a row's tokens that templates know, in ``order``, and ``hits`` those of prefixes.
    """
    each = rows.select("rid", "held", "text", F.explode("hits").alias("token")).join(index, "token")
    shared = F.array_intersect("tokens", "held")  # in the template's order
    first = F.element_at("shared", 1)
    reach = F.least(F.size("tokens") + 1 - F.array_position("tokens", first), F.size("held") + 1 - F.array_position("held", first))
    # a row meets a template once, by the first of the prefix that it holds
    near = each.withColumn("shared", shared).where((F.size("shared") >= F.col("need")) & (F.col("token") == first) & (reach >= F.col("need")))
    ranks = F.transform(_words(F.col("text")), lambda w: F.array_position("tokens", w).cast("int"))
    placed = near.select("rid", "tid", "label", "names", "tokens", "need", "named", "width", ranks.alias("ranks"))
    at = lambda good: F.array_compact(F.transform("ranks", lambda r, i: F.when(good(r), i)))
    prefix = F.size("tokens") - F.col("need") + 1
    starts = placed.withColumns({"starts": at(lambda r: r > 0), "rare": at(lambda r: (r > 0) & (r <= prefix))})
    some = F.filter("starts", lambda i: F.exists("rare", lambda q: (q >= i) & (q < i + F.col("width"))))
    named = F.size(F.array_intersect("names", F.transform("block", lambda r: F.element_at("tokens", r)))) >= F.col("named")
    blocks = starts.withColumn("i", F.explode(some)).withColumn("block", F.filter(F.array_distinct(F.slice("ranks", F.col("i") + 1, F.col("width"))), lambda r: r > 0))
    good = blocks.where(F.size("block") >= F.col("need")).select("rid", "tid", "label", named.alias("named"), (F.size("block") / F.size("tokens")).alias("score"))
    best = good.groupBy("rid", "tid").agg(F.max("label").alias("label"), F.max("named").alias("named"), F.max("score").alias("score"))
    return best.select("rid", F.when(F.col("named"), F.col("label")).otherwise(OTHER).alias("label"), "score")


def _places(phrase: str) -> Column:
    """The starts of a phrase in the column ``words``."""
    wanted = phrase.split(" ")

    def start(word: Column, i: Column) -> Column:
        here = word == wanted[0]
        for k, w in enumerate(wanted[1:], 1):
            here = here & (F.coalesce(F.get("words", i + k), F.lit("")) == w)
        return F.when(here, i)

    return F.array_compact(F.transform("words", start))


def license_scan(
    docs: DataFrame, phrase_labels: Mapping[str, str] = PHRASES, templates: Sequence[Notice] = TEMPLATES, threshold: float = 0.8, notices: Mapping[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts, first and last place, labels and score; the score is the best containment, 1 where a phrase stands."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = [_Template(t, threshold) for t in templates]
    known = sorted(set().union(*(t.tokens for t in each)))
    counts = token_frequencies(plain.select(F.array_intersect(_words(F.col("text")), F.lit(known).cast("array<string>")).alias("held"))) if known else {}
    order = sorted(known, key=lambda t: (counts.get(t, 0), t))
    index, rare = _index(docs.sparkSession, each, counts)
    strings = lambda xs: F.lit(xs).cast("array<string>")
    cut = plain.withColumn("words", _words(F.col("text")))
    cut = cut.withColumns({"held": F.array_intersect(strings(order), F.array_intersect("words", strings(known))), **{f"_p{k}": _places(p) for k, p in enumerate(phrase_labels)}, **{f"_n{k}": F.size(_places(p)) > 0 for k, p in enumerate(notices)}})
    every = F.concat(*[F.col(f"_p{k}") for k in range(len(phrase_labels))]) if phrase_labels else F.array().cast("array<int>")
    labels = lambda when, names: F.array_compact(F.array(*[F.when(when(k), F.lit(x)) for k, x in enumerate(names)]).cast("array<string>"))
    base = cut.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").cast("bigint").alias("n_words"), every.alias("places"), "held", F.array_intersect("held", strings(rare)).alias("hits"),
        labels(lambda k: F.size(f"_p{k}") > 0, phrase_labels.values()).alias("base"), labels(lambda k: F.col(f"_n{k}"), notices.values()).alias("more"), "text",
    )
    reach = (F.size("hits") > 0) & (F.size("held") >= min((t.need for t in each), default=1))
    none = F.lit(None).cast("array<string>")
    base = base.withColumns({"text": F.when(reach, F.col("text")), "held": F.when(reach, F.col("held")).otherwise(none), "hits": F.when(reach, F.col("hits")).otherwise(none)})
    kept = materialise(base, "license-rows")
    met = _met(kept.where("text is not null").select("rid", "held", "hits", "text"), index, order).groupBy("rid").agg(F.collect_set("label").alias("met"), F.max("score").alias("best"))
    rows = kept.drop("text", "held", "hits").join(met, "rid", "left")
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
        listed(F.col("base")).alias("base_labels"), listed(F.concat("base", "more", F.coalesce("met", F.array().cast("array<string>")))).alias("labels"),
        F.when((F.size("places") > 0) | (F.size("more") > 0), F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle_sql(phrase_labels: Mapping[str, str] = PHRASES, templates: Sequence[Notice] = TEMPLATES, threshold: float = 0.8, notices: Mapping[str, str] = NOTICES) -> str:
    """The same over the view ``documents``: every block that begins with a token of a template is held against it."""
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    words = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
    phrases = lambda xs: " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: {' AND '.join(f'''w[i + {k}] = '{x}' ''' for k, x in enumerate(p.split(' '), 1))})) AS place FROM texts" for p, label in xs.items()
    )
    each = [_Template(t, threshold) for t in templates]
    held = ", ".join(f"({k}, '{t.label}', {listed(sorted(t.tokens))}, {listed(t.names)}, {t.need}, {t.named}, {t.width})" for k, t in enumerate(each))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
places AS ({phrases(phrase_labels)}),
base AS (SELECT r, count(*) AS n, min(place) AS f, max(place) AS l, list(DISTINCT label) AS labels FROM places GROUP BY r),
notice AS (SELECT r, list(DISTINCT label) AS labels FROM ({phrases(notices)}) GROUP BY r),
template(id, label, tokens, names, need, named, width) AS (VALUES {held}),
near AS (SELECT r, id, label, tokens, names, need, named, width, w FROM texts, template WHERE len(list_intersect(list_distinct(w), tokens)) >= need),
block AS (SELECT r, id, label, tokens, names, need, named, list_distinct(w[i:i + width - 1]) AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM near) WHERE list_contains(tokens, w[i])),
share AS (SELECT r, id, label, len(list_intersect(s, names)) >= named AS good, need, len(list_intersect(s, tokens)) AS n, len(tokens) AS size FROM block),
best AS (SELECT r, CASE WHEN bool_or(good) THEN label ELSE '{OTHER}' END AS label, max(n / size::DOUBLE) AS score FROM share WHERE n >= need GROUP BY r, id, label),
met AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS score FROM best GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
  coalesce(list_aggregate(list_sort(base.labels), 'string_agg', ','), '') AS base_labels,
  coalesce(list_aggregate(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(notice.labels, []), coalesce(met.labels, [])))), 'string_agg', ','), '') AS labels,
  CASE WHEN n > 0 OR notice.r IS NOT NULL THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM texts LEFT JOIN base USING (r) LEFT JOIN met USING (r) LEFT JOIN notice USING (r)"""
