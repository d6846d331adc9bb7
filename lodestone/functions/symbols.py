"""Symbols of source code and titles, their normal form, signal words, and learned error phrases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.patterns import contained
from .text import strip


@dataclass(frozen=True)
class SymbolRule:
    kind: str
    pattern: str
    weight: float


#: Names of operators, settings and short names of features, with their weights, in order.
SYMBOL_RULES = (
    SymbolRule("kernel", r"\b(aclnn[A-Z][A-Za-z0-9_]*|npu[A-Z][A-Za-z0-9_]*)\b", 3.0),
    SymbolRule("kernel", r"\b((?:dispatch|distribute|token|moe|init|sort|gather|mega|router)[a-z0-9_]*_(?:combine|dispatch|gather|scatter|reduce|route|permute|moe)[a-z0-9_]*)\b", 2.5),
    SymbolRule("kernel", r"\b((?:mega|dsa|mla|sfa|dcp|pcp|eplb|dp|tp|ep|cp|fc|kv|swa|gqa|mtp|flashcomm|mooncake|layerwise|ascendstore|recompute|balance|prefill|decode)[a-z0-9_]*_(?:moe|cp|dp|ep|tp|mc2|kv|cache|offload|sched|routing|mask)[a-z0-9_]*)\b(?<!_meta)", 2.0),
    SymbolRule("feature", r"\b((?:[A-Z]+_)?ASCEND_[A-Z0-9_]+|HCCL_[A-Z0-9_]+)\b", 2.0),
    SymbolRule("feature", r"\b(enable_[a-z0-9_]+)\b", 1.8),
    SymbolRule("feature", r"\b(FUSED_MC2|MC2|MLAPO|PCP|DCP|EPLB|SFA|DSA|MTP|C8|NZ|MXFP|SP|PP|TP|DP)\b", 1.5),
)
#: Words that say nothing, and suffixes that one operator may have.
STOP_SYMBOLS = (
    "init", "process", "compute", "params", "switch", "reset", "align", "while", "constexpr", "context", "copyout", "copyin", "ceildiv", "roundup", "opdef", "blockepilogue", "makelayout", "posttiling", "prefixtiling",
    "getplatforminfo", "getworkspacesize", "gettilingkey", "alloc", "free", "copy", "move", "write", "read", "update", "apply", "check", "validate", "print", "log", "trace", "debug", "info", "warn", "error", "exception",
)
SUFFIXES = ("getworkspacesize", "inner", "_meta", "w4a8", "w8a8", "bf16", "v2", "v3")
#: Model names, and versions of the stack, as titles name them.
MODEL = r"\b(GLM-?5(?:\.\d+)?|DeepSeek-?V4[-A-Za-z0-9]*|Qwen3(?:\.\d+)?[-A-Za-z0-9]*|MiniMax-?M[0-9.]+|Kimi-?K[0-9.]+|Bailing[-\w]*)"
STACK_VERSION = r"\b(CANN\s*\d+\.\d+(?:\.\d+)?|HDK\s*\d+\.\d+(?:\.\d+)?|torch-?npu\s*\d+\.\d+(?:\.\d+)?|[a-z]+[-_]ascend\s*v?\d+\.\d+(?:\.\d+)?)\b"
#: Which words of a title are names, and where a title is cut.
TITLE_TOKEN = r"^(?:[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+|[A-Z][a-z]+(?:[A-Z][a-z0-9]*)+|[A-Z]{2,}[0-9]*|[A-Z][a-z]{2,})$"
TITLE_CUT = r"[\s,;:()\[\]{}<>/|&+=]+"
#: Lines that report an error, what of them is a phrase, phrases that say nothing, words that a phrase needs.
ERROR_LINE = r"(?im)^\s*(?:\[?ERROR\]?|\[?Error\]?|>>>?\s*)?(?=[^\[\]\n]*(?:failed|error|exception|timeout|trap|abort|crash|assert|out of memory)[^\[\]\n]*)[^\n]{8,160}$"
ERROR_PHRASE = r"""(?:reason|errStr|errorStr|detail|message)\s*[=:]\s*["']?([A-Za-z][A-Za-z0-9 _\-]{5,80})|([A-Za-z][A-Za-z0-9 ]{5,60}?(?:failed|error|exception|timeout|trap|abort|out of memory))"""
STOP_PHRASES = ("error occurred", "an error occurred", "error message", "error log", "error info", "failed to", "the error", "this error", "error code", "error is", "error while", "please check", "check the", "see the", "the following error", "following error")
PHRASE_MARKS = ("fail", "error", "exception", "timeout", "trap", "abort", "crash", "memory", "invalid", "out of", "synchroniz", "all_gather", "allgather", "vector core", "hccl", "smmu", "mte", "aiv", "aicore")


#: The shortest signal word that counts, how many are given, and the kind of learned phrases.
SIGNAL_CHARS, SIGNALS, PHRASE_KIND = 4, 15, "phrase"


def extract_symbols(sources: DataFrame, rules: Sequence[SymbolRule] = SYMBOL_RULES) -> DataFrame:
    """version, name, kind, weight, rule of every rule's matches in sources (version, content); ``rule`` is its place."""
    out = None
    for k, r in enumerate(rules):
        part = sources.select("version", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r.pattern), F.lit(1)))).alias("name"))
        part = part.where(~F.lower("name").isin(*STOP_SYMBOLS)).select("version", "name", F.lit(r.kind).alias("kind"), F.lit(r.weight).alias("weight"), F.lit(k).alias("rule"))
        out = part if out is None else out.unionByName(part)
    return out


def title_mentions(titles: DataFrame, title_col: str = "title") -> DataFrame:
    """version, name, kind, weight, rule of models and stack versions that titles name, in any case; their version is ``kb``."""
    out = None
    for k, (kind, pattern, weight) in enumerate((("model", f"(?i){MODEL}\\b", 1.0), ("version", f"(?i){STACK_VERSION}", 0.8))):
        part = titles.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(title_col, F.lit("")), F.lit(pattern), F.lit(1)))).alias("name"))
        part = part.select(F.lit("kb").alias("version"), "name", F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), F.lit(100 + k).alias("rule"))
        out = part if out is None else out.unionByName(part)
    return out


def phrase_symbols(phrases: DataFrame) -> DataFrame:
    """Learned phrases (phrase, weight) as symbols."""
    return phrases.select(F.lit("kb").alias("version"), F.col("phrase").alias("name"), F.lit(PHRASE_KIND).alias("kind"), "weight", F.lit(200).alias("rule"))


def symbol_table(symbols: DataFrame) -> DataFrame:
    """One row for each name in lower case: kind and weight of where it was met first (versions in order, then rules), its versions in order."""
    first = F.min_by(F.struct("name", "kind", "weight"), F.struct(F.when(F.col("version") == "kb", 1).otherwise(0), "version", "rule", "name"))
    table = symbols.groupBy(F.lower("name").alias("key")).agg(first.alias("b"), F.array_sort(F.collect_set("version")).alias("versions"))
    return table.select("key", "b.name", "b.kind", "b.weight", "versions")


def by_weight(table: DataFrame) -> DataFrame:
    """The table's rows, heaviest first."""
    return table.orderBy(F.desc("weight"), "key")


def lookup(table: DataFrame, name: str) -> DataFrame:
    """The symbol of that name in any case, else those of its normal form."""
    norm = normalised(F.lit(name))
    exact = table.where(F.col("key") == name.lower())
    other = table.where((normalised(F.col("name")) == norm) & (F.col("key") != name.lower()))
    return exact.withColumn("match", F.lit("name")).unionByName(other.withColumn("match", F.lit("form")))


def normalised(name: Column) -> Column:
    """One form for the spellings of an operator: without suffixes, words parted by underscores, lower case."""
    out = F.trim(name)
    for s in SUFFIXES:
        out = F.regexp_replace(out, f"(?i){s}$", "")
    out = F.regexp_replace(out, "(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.lower(F.regexp_replace(out, "(?<=[A-Z])(?=[A-Z][a-z])", "_"))


def match_symbols(texts: DataFrame, table: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, name, kind, weight, place of the symbols that each text holds anywhere, in any case, or as a whole word in another
    spelling (weight 0.9). Longest first, then heaviest.

    Symbols of any script are found by one automaton over the texts; other spellings by joins of words' normal forms. Null
    texts hold nothing.
    """
    rows = texts.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    inside = contained(rows.withColumn("text", F.lower("text")), table).distinct().join(table, "key").select("id", "name", "kind", "weight")
    all_of = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    words = F.concat(F.filter(all_of("[A-Za-z0-9_]+"), lambda t: t.rlike("^[A-Za-z]")), all_of("[A-Za-z][A-Za-z0-9_]*"))
    tokens = rows.select("id", F.explode(F.array_distinct(words)).alias("token"))
    norms = table.select(normalised(F.col("name")).alias("norm"), "kind", "weight", "key").groupBy("norm").agg(F.min_by(F.struct("kind", "weight"), "key").alias("b"))
    other = tokens.where(F.length("token").between(3, 48)).withColumn("norm", normalised(F.col("token"))).where(F.col("norm") != F.lower("token"))
    # words that are their own normal form, most of all, are left out before anything is shuffled
    variant = other.distinct().join(norms, "norm").select("id", F.col("token").alias("name"), F.col("b.kind"), (F.col("b.weight") * 0.9).alias("weight"))
    direct = inside.withColumn("late", F.lit(0))
    both = direct.unionByName(variant.withColumn("late", F.lit(1))).groupBy("id", F.lower("name").alias("name"), "kind").agg(F.min_by("weight", F.struct("late", -F.col("weight"))).alias("weight"))
    order = Window.partitionBy("id").orderBy(F.desc(F.length("name")), F.desc("weight"), "name", "kind")
    return both.withColumn("place", F.row_number().over(order))


def match_signal_words(texts: DataFrame, words: DataFrame, phrases: DataFrame | None = None, id_col: str = "id", text_col: str = "text", top: int = SIGNALS) -> DataFrame:
    """id, word, score, place of the signal words (word, score) of four characters or more that each text holds in any case,
    and of the learned phrases (phrase, weight) of any length: longest first, then by score, ``top`` of them.
    """
    some = words.where(F.length("word") >= SIGNAL_CHARS).select("word", F.col("score").cast("double").alias("score"), F.lit(0).alias("late"))
    if phrases is not None:
        some = some.unionByName(phrases.select(F.col("phrase").alias("word"), F.col("weight").cast("double").alias("score"), F.lit(1).alias("late")))
    once = some.groupBy(F.lower("word").alias("key")).agg(F.min_by(F.struct("word", "score"), F.struct("late", -F.col("score"), "word")).alias("b")).select("key", "b.*")
    rows = texts.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    hits = contained(rows.withColumn("text", F.lower("text")), once).distinct().join(once, "key")
    order = Window.partitionBy("id").orderBy(F.desc(F.length("word")), F.desc("score"), "word")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("id", "word", "score", "place")


def title_tokens(title: Column, stop: Sequence[str]) -> Column:
    """The proper words of a title: camel case, underscores, capitals; without stop words."""
    parts = F.filter(F.split(F.coalesce(title, F.lit("")), TITLE_CUT), lambda t: t.rlike(TITLE_TOKEN) & (F.length(t) >= 3))
    return F.filter(parts, lambda t: ~F.lower(t).isin(*stop)) if stop else parts


def signal_words(titles: DataFrame, stop: Sequence[str] = (), top: int = 300, title_col: str = "title") -> DataFrame:
    """word, docs, idf, score of the words and pairs of neighbours that titles hold, highest score first."""
    words = titles.select(title_tokens(F.col(title_col), stop).alias("w"))
    upper = lambda t: F.substring(t, 1, 1).rlike("[A-Z]")
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.when(upper(a) & upper(b), F.concat_ws(" ", a, b)))
    each = words.where(F.size("w") > 0).select(F.array_distinct(F.concat("w", F.filter(pairs, lambda p: p.isNotNull()))).alias("w"))
    total = each.count()
    counts = each.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    scored = counts.withColumn("idf", F.log(F.lit(float(max(total, 1))) / F.col("docs")) + 1.0).withColumn("score", F.col("docs") * F.col("idf"))
    return scored.orderBy(F.desc("score"), "word").limit(top)


def learned_phrases(texts: DataFrame, least: int = 3, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """phrase, weight: what stands in error lines of one text ``least`` times or more; the best weight of all texts."""
    lines = texts.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(ERROR_LINE), F.lit(0))).alias("line"))
    both = F.zip_with(*[F.regexp_extract_all(strip(F.col("line")), F.lit(ERROR_PHRASE), F.lit(g)) for g in (1, 2)], lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b))
    phrase = lines.select("id", F.explode(both).alias("raw")).withColumn("raw", F.regexp_replace(strip(F.col("raw")), "^[\"']+|[\"']+$", "")).withColumn("phrase", F.lower("raw"))
    marked = F.col("phrase").rlike("|".join(PHRASE_MARKS)) | F.col("raw").rlike("^[A-Z][a-z]+(?:[A-Z][a-z0-9]*)+$")
    counts = phrase.where(F.length("raw").between(6, 90) & ~F.col("phrase").isin(*STOP_PHRASES) & marked).groupBy("id", "phrase").count().where(F.col("count") >= least)
    return counts.groupBy("phrase").agg(F.max(F.least(F.lit(1.5), 0.8 + 0.1 * F.col("count"))).alias("weight"))


def learned_delta(texts: DataFrame, table: DataFrame, least: int = 3, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row: how many phrases the texts teach that the symbol table (key) doesn't have."""
    new = learned_phrases(texts, least, id_col, text_col).join(table.select(F.col("key").alias("phrase")), "phrase", "left_anti")
    return new.agg(F.count("*").alias("n"))


#: Definitions in source lines.
CODE_RULES = (
    ("def", r"^(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 0),
    ("class", r"^class\s+([A-Za-z_][A-Za-z0-9_]*)", 0),
    ("type", r"\b(?:class|struct)\s+([A-Za-z_][A-Za-z0-9_]*)", 4),
    ("function", r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\([^)]*\)\s*(?:const)?\s*\{", 4),
    ("operator", r"\b(aclnn[A-Z][A-Za-z0-9_]*|npu[A-Z][A-Za-z0-9_]*)", 0),
    ("kernel", r"\b([a-z0-9_]+_combine|[a-z0-9_]+_dispatch)\b", 0),
    ("setting", r"\b((?:[A-Z]+_)?ASCEND_[A-Z0-9_]+|HCCL_[A-Z0-9_]+)", 0),
)
#: Fixed value: the simpler index has definitions of one language only.
DEF_RULES = CODE_RULES[:2]


def source_lines(sources: DataFrame) -> DataFrame:
    """version, path, line (from 1), text of every line of sources (version, path, content)."""
    lines = sources.select("version", "path", F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\r\n|\n|\r")).alias("line", "text"))
    return lines.withColumn("line", F.col("line") + 1)


def code_symbols(sources: DataFrame, rules: Sequence[tuple[str, str, int]] = CODE_RULES) -> DataFrame:
    """version, symbol, path, line, snippet of every definition. Function heads may span lines: whole files are searched
    for each rule, and a match's line is counted from the text before it.
    """
    out = None
    for _, pattern, least in rules:
        flagged = "(?m)" + pattern
        parts = F.split(F.regexp_replace(F.coalesce("content", F.lit("")), F.lit(flagged), F.lit("\x01$1\x02$0")), "\x01")
        # a part after the first begins with the name, then the match and what follows; its line is that of all line ends before
        breaks = lambda p: F.size(F.split(F.substring_index(p, "\x02", -1), "\n")) - 1
        spot = lambda acc, p: F.struct((acc["line"] + breaks(p)).alias("line"), F.concat(acc["found"], F.array(F.struct(F.substring_index(p, "\x02", 1).alias("symbol"), acc["line"].alias("line")))).alias("found"))
        start = F.struct((breaks(F.get(parts, F.lit(0))) + 1).alias("line"), F.array().cast("array<struct<symbol:string,line:int>>").alias("found"))
        met = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, spot, lambda acc: acc["found"])
        lines = F.split(F.coalesce("content", F.lit("")), "\n")
        cut = F.transform(met, lambda m: F.struct(F.lower(m["symbol"]).alias("symbol"), m["line"].alias("line"), F.substring(strip(F.coalesce(F.get(lines, m["line"] - 1), F.lit(""))), 1, 120).alias("snippet")))
        rows = sources.where(F.coalesce("content", F.lit("")).rlike(flagged)).select("version", "path", F.explode(cut).alias("m")).select("version", "m.symbol", "path", "m.line", "m.snippet").where(F.length("symbol") >= least)
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()
