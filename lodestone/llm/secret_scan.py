"""Secret scans over whole texts with a trigram inverted index.

1. From each rule's expression a Boolean query of trigrams is derived.
2. The index has a posting (trigram, document) for each trigram that some query names; a text is read once for all of them.
3. Postings are intersected for all rules at once: each brings its trigram's bit to its document, where they are put
   together before and after one shuffle, and a rule's query is asked of the bits. What satisfies it is a candidate.
4. Rules run on their candidates only; rules without a mandatory trigram run on every text.

The candidates are written to the shared folder before they are joined, so their size is known: where it is under the
session's broadcast threshold the texts stay where they are, else both sides are shuffled on the id.

All of it is DataFrame functions. Offsets are code points, the end is exclusive. Defined cases: a null text counts as
empty; ids may be null or repeated, and each row gets its own result; kinds may overlap each other, matches of one kind
don't. U+0001 and U+0002 in a text are taken for U+0003 while positions are found, which changes no position.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise
from .trigram_query import evaluate, trigram_query, trigrams_of


@dataclass(frozen=True)
class SecretRule:
    """``group`` must have ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The base rules. Runs of hex figures are asked for with their least length, which finds the same matches.
BASE_RULES = (
    SecretRule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    SecretRule("access", r"AKIA[A-Z0-9]+", 20),
    SecretRule("hex", r"[0-9a-f]{24,}", 24),
)
#: Kinds of secrets that providers document.
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES
OPEN, CLOSE, SPARE = "\x01", "\x02", "\x03"
SPAN = "array<struct<start:int,k:int,end:int,kind:string>>"


#: Trigrams that share a long of bits.
WORD = 63


def _one_of(trigrams: Sequence[str]) -> str:
    """An expression that finds each place of any of ``trigrams``, overlapping ones too, by their first letters."""
    quote = lambda x: "".join(rf"\x{{{ord(c):x}}}" for c in x)
    first = sorted({t[0] for t in trigrams})
    return "(?=(" + "|".join(f"{quote(c)}(?:{'|'.join(quote(t[1:]) for t in trigrams if t[0] == c)})" for c in first) + "))"


def trigram_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings: a row (trigram, doc_id) for each of ``trigrams`` that the lower-cased text holds."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_one_of(trigrams)), F.lit(1)))
    return docs.select(F.explode(held).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules: Sequence[SecretRule]) -> DataFrame:
    """doc_id and the kinds whose queries its postings satisfy; documents without any are left out."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    order = sorted(set().union(*(trigrams_of(q) for q in queries.values())))
    bit = {t: (k // WORD, 1 << k % WORD) for k, t in enumerate(order)}
    parts = range(-(-len(order) // WORD))
    brings = [F.bit_or(F.coalesce(*[F.when(F.col("trigram") == t, F.lit(b)) for t, (k, b) in bit.items() if k == part], F.lit(0)).cast("bigint")).alias(f"bits{part}") for part in parts]
    held = index.where(F.col("trigram").isin(order)).groupBy("doc_id").agg(*brings)
    has = lambda t: F.col(f"bits{bit[t][0]}").bitwiseAND(F.lit(bit[t][1])) != 0
    kinds = F.array_compact(F.array(*[F.when(evaluate(q, has), F.lit(k)) for k, q in queries.items()]))
    return held.select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


#: Matches that are put together at once: what a text's matches cost doesn't grow with the square of their number.
GROUP = 256


def _spans(text: Column, rule: SecretRule, k: int) -> Column:
    """All matches: the text is marked around them and cut at the marks, then the lengths of the parts are summed up."""
    parts = F.split(F.regexp_replace(text, F.lit(rule.pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN)

    def step(acc: Column, part: Column) -> Column:
        match = F.substring_index(part, CLOSE, 1)
        held = F.length(F.regexp_extract(match, rule.pattern, rule.group) if rule.group else match) >= rule.least
        span = F.struct(acc["at"].alias("start"), F.lit(k).alias("k"), (acc["at"] + F.length(match)).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.when(held, F.concat(acc["found"], F.array(span).cast(SPAN))).otherwise(acc["found"]).alias("found"))

    def of_group(acc: Column, first: Column) -> Column:
        none = F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("found"))
        done = F.aggregate(F.slice(acc["parts"], first, GROUP), none, step)
        return F.struct(done["at"].alias("at"), F.concat(acc["found"], F.array(done["found"])).alias("found"), acc["parts"].alias("parts"))

    start = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"), parts.alias("parts"))
    groups = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2)), F.lit(GROUP))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(groups, start, of_group, lambda acc: F.flatten(acc["found"]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, rules: Sequence[SecretRule] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, ``spans`` (an array by start, then by the order of the rules), and the columns named in ``keep``."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)
    indexed = [r for r in rules if trigram_query(r.pattern) is not True]
    if indexed:
        trigrams = sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in indexed)))
        found = materialise(candidates(trigram_index(id_text(docs, id_col, text_col), trigrams), indexed), "secret-candidates")
        found = found.withColumnRenamed("doc_id", "candidate")
        plain = plain.join(found, F.col("doc_id").eqNullSafe(F.col("candidate")), "left").drop("candidate")
    text, always = F.translate("text", OPEN + CLOSE, SPARE + SPARE), {r.kind for r in rules} - {r.kind for r in indexed}
    clean = F.when(F.col("text").rlike(f"[{OPEN}{CLOSE}]"), text).otherwise(F.col("text"))
    each = []
    for k, r in enumerate(rules):
        runs = F.col("text").rlike(r.pattern) if r.kind in always else F.array_contains("kinds", r.kind)
        each.append(F.when(runs, _spans(clean, r, k)).otherwise(F.array().cast(SPAN)))
    return plain.select("doc_id", *keep, F.array_sort(reduce(lambda a, b: F.concat(a, b), each)).alias("spans"))


def _count(k: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["k"] == k)).cast("bigint")


def secret_scan(docs: DataFrame, base: Sequence[SecretRule] = BASE_RULES, more: Sequence[SecretRule] = MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    found = secret_spans(docs, [*base, *more], id_col, text_col)
    counts = [_count(k).alias(f"n_{r.kind}") for k, r in enumerate(base)]
    digest = F.sha2(_listed(F.filter("spans", lambda s: s["k"] < len(base))), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact_secrets(docs: DataFrame, rules: Sequence[SecretRule] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with each stretch that spans cover replaced by ``mark``; spans that meet or overlap are one.

    A null text stays null; a text without spans stays as it is, whatever characters it has. Every row stays.
    A table with the columns doc_id and text keeps all its columns; n_chars, if there, follows the new text.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    renamed = docs.select("doc_id", F.col("text"), F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("_rest"), F.col("text").alias("_text"))
    found = secret_spans(renamed, rules, keep=("_rest", "_text"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.col("_text").substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = (s["start"] > acc["at"]) | (acc["out"] == "")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.col("_text").substr(acc["at"] + 1, F.length("_text"))))
    out = found.select("doc_id", F.when(F.size("spans") > 0, clean).otherwise(F.col("_text")).alias("text"), "_rest")
    columns = []
    for c in docs.columns:
        columns.append(F.col(c) if c in ("doc_id", "text") else F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col("_rest")[c].alias(c))
    return out.select(*columns)


def oracle_sql(base: Sequence[SecretRule] = BASE_RULES, more: Sequence[SecretRule] = MORE_RULES) -> str:
    """The same over the view ``documents``, every rule tried on every text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rules = [*base, *more]
    each = " UNION ALL ".join(
        f"SELECT r, {k} AS k, '{x.kind}' AS kind, {x.least} AS least, {quote(x.pattern)} AS pattern, {x.group} AS grp, "
        f"string_split(regexp_replace(t, {quote(x.pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts, regexp_extract_all(t, {quote(x.pattern)}, {x.group}) AS held FROM texts"
        for k, x in enumerate(rules)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{x.kind}') AS n_{x.kind}" for x in base)
    line = "kind || ':' || s || ':' || e"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
marked AS ({each}),
cut AS (SELECT r, k, kind, least, parts, held, unnest(range(2, len(parts) + 1)) AS i FROM marked WHERE len(parts) > 1),
spans AS (SELECT r, k, kind, list_sum(list_transform(parts[1:i - 1], lambda x: length(x)))::BIGINT - (i - 2) AS s,
    strpos(parts[i], chr(2)) - 1 AS n, length(held[i - 1]) >= least AS good FROM cut),
found AS (SELECT r, k, kind, s, s + n AS e FROM spans WHERE good),
per AS (SELECT r, {counts}, string_agg({line}, ',' ORDER BY s, k) FILTER (k < {len(base)}) AS b, string_agg({line}, ',' ORDER BY s, k) AS a FROM found GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) AS n_{x.kind}" for x in base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM texts LEFT JOIN per USING (r)"""
