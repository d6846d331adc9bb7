"""Error signatures of a text: fixed expressions, parsed structure and phrases, as an array of structs.

Each signature has kind, text (lower case), weight and origin. Names of one deployment's components, operators and
settings are parameters (``SignatureRules``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .symbols import MODEL
from .text import strip

SIGNATURE = "array<struct<kind:string,text:string,weight:double,origin:string>>"
#: Phrases that name an error by themselves.
PHRASES = ("timeout or trap error", "trap error", "out of memory", "out pf memory", "illegal memory access", "smmu fault", "smmu", "aivector error", "aivec error", "mt3 error", "mte address", "vector core exception", "hccl failure", "suspected remote error", "workspace", "halmemcreate")
#: Codes in running text, and what stands before a value.
ACL_CODE = r"\b(E\d{4,6}|10[7-9]\d{3}|50\d{4}|56\d{4}|0x[0-9a-fA-F]{5,8})\b"
CODE_KEYS = ("drvretcode", "retcode", "errcode", "err_code", "error_code", "error code", "errno")
NAME_KEYS = ("kernel_name", "kname", "errstr", "detail", "error")
KEY_VALUE = r"""\b(kernel_name|kName|kname|errorStr|errStr|detail|retCode|drvRetCode|errCode|err_code|error_code|error code|errno|error)\s*[=:]\s*["']?([^"',;\n]{2,80})"""
EXCEPTION = r"(?m)^([A-Za-z_][A-Za-z0-9_]*(?:Error|Exception|Failure))\s*:"
STACK = r"""File\s+"([^"]+)",\s*line\s+(\d+)(?:,\s*in\s+([A-Za-z_][A-Za-z0-9_]*))?"""


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    groups: tuple[int, ...]
    weight: float
    origin: str


@dataclass(frozen=True)
class SignatureRules:
    """The first layer where no symbol table is at hand, the roots of module paths, and version forms."""

    #: Fixed values.
    first: Sequence[Rule] = (
        Rule("kernel", r"""(?:kernel_name|kName|kname)\s*=\s*["']?([A-Za-z_][A-Za-z0-9_]*)""", (1,), 3.5, "kernel_name="),
        Rule("kernel", r"\b(aclnn[A-Z][A-Za-z0-9_]*|npu[A-Z][A-Za-z0-9_]*|_C_ascend::[A-Za-z0-9_]+)", (1,), 3.0, "aclnn"),
        Rule("op", r"\b(dispatch_ffn_combine|mega_moe|moe_[a-z0-9_]+|[a-z]+_[a-z0-9_]+_combine|[a-z]+_[a-z0-9_]+_dispatch)\b", (1,), 2.5, "op"),
        Rule("errcode", r"(?:drvRetCode|retCode)\s*[=: ]\s*(\d{1,7})|(?:error code|errCode|err_code|error_code)\s*[=: ]\s*(\d{3,7})", (1, 2), 3.0, "errcode"),
        Rule("errcode", r"\b(?:ACL_|aclnn)?(?:error|errno)?\s*(?:code|number)\s*[=:]\s*(\d{6})\b", (1,), 2.5, "errno"),
        Rule("errcode", r"(?i)\b(?:failed|error|exception)[^\n]{0,40}\b(107\d{3}|50[0-9]\d{3}|56\d{4}|0x[0-9a-f]{5,8})\b", (1,), 2.5, "raw"),
        Rule("env", r"\b((?:[A-Z]+_)?ASCEND_[A-Z0-9_]+|HCCL_[A-Z0-9_]+|enable_[a-z0-9_]+|FUSED_MC2|MLAPO|PCP|DCP|EPLB)\b", (1,), 1.2, "env"),
        Rule("model", MODEL + r"\b", (1,), 1.0, "model"),
    )
    roots: Sequence[str] = ("csrc", "torch_npu", "torch")
    versions: str = r"(?i)\b(CANN\s*\d+\.\d+(?:\.\d+)?|HDK\s*\d+\.\d+(?:\.\d+)?|torch-?npu\s*\d+\.\d+(?:\.\d+)?)\b"
    phrases: Sequence[str] = PHRASES


RULES = SignatureRules()


def _signatures(texts: Column, kind: str, weight: Column | float, origin: str, any_length: bool = False) -> Column:
    """Trimmed of space and quotes, in lower case; short ones only where the kind allows it."""
    w = weight if callable(weight) else lambda t: F.lit(float(weight))
    out = F.transform(texts, lambda t: F.lower(F.regexp_replace(strip(t), "^[\"']+|[\"']+$", "")))
    out = F.filter(out, lambda t: F.length(t) >= (1 if any_length else 3))
    return F.transform(out, lambda t: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("text"), t, F.lit("weight"), w(t), F.lit("origin"), F.lit(origin))).cast(SIGNATURE)


def _found(text: Column, rule: Rule) -> Column:
    each = [F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in rule.groups]
    texts = each[0] if len(each) == 1 else F.filter(F.zip_with(each[0], each[1], lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)), lambda t: t != "")
    if rule.origin == "errcode":  # one figure alone says little
        return _signatures(texts, "errcode", lambda t: F.when(F.length(t) == 1, 1.0).otherwise(F.lit(rule.weight)), rule.origin, True)
    return _signatures(texts, rule.kind, rule.weight, rule.origin, rule.kind == "errcode")


def key_values(text: Column) -> Column:
    """array<struct<key,value>> of the fixed keys; values are trimmed."""
    keys, values = (F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(g)) for g in (1, 2))
    return F.zip_with(keys, values, lambda k, v: F.named_struct(F.lit("key"), F.lower(k), F.lit("value"), strip(v)))


def parsed(text: Column, rules: SignatureRules = RULES) -> Column:
    """What the structure of an error report gives: stack frames, exception types, key-value pairs, paths, codes, versions."""
    all_of = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    roots = "|".join(rules.roots)
    of_keys = lambda names: F.transform(F.filter(key_values(text), lambda s: s["key"].isin(*names)), lambda s: s["value"])
    files = F.filter(F.transform(all_of(STACK, 1), lambda p: F.regexp_extract(p, rf"((?:{roots})/[A-Za-z0-9_./\-]+\.py)", 1)), lambda t: t != "")
    return F.concat(
        _signatures(F.filter(all_of(STACK, 3), lambda t: t != ""), "stack_func", 2.5, "stack"),
        _signatures(files, "module", 1.5, "stack"),
        _signatures(all_of(EXCEPTION, 1), "phrase", 1.2, "exc"),
        _signatures(of_keys(CODE_KEYS), "errcode", 3.0, "code=", True),
        _signatures(of_keys(NAME_KEYS), "op", 2.0, "name="),
        _signatures(all_of(rf"\b((?:{roots})/[A-Za-z0-9_./\-]+)", 1), "module", 1.0, "module"),
        _signatures(all_of(ACL_CODE, 1), "errcode", 3.0, "acl", True),
        _signatures(all_of(rules.versions, 1), "version", 0.8, "version"),
    )


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def deduped(signatures: Column) -> Column:
    """The first of each kind and text; then, but for codes, without what a longer one of its kind contains."""

    def first(all_of: Column) -> Column:
        return F.filter(all_of, lambda s, i: ~F.exists(F.slice(all_of, F.lit(1), i), lambda t: (t["kind"] == s["kind"]) & (t["text"] == s["text"])))

    def longest(some: Column) -> Column:
        return F.filter(some, lambda s: (s["kind"] == "errcode") | ~F.exists(some, lambda t: (t["kind"] == s["kind"]) & (F.length(t["text"]) > F.length(s["text"])) & F.contains(t["text"], s["text"])))

    return _once(signatures, lambda x: _once(first(x), longest))


#: A symbol's kind as a signature's; others are operators.
SYMBOL_KINDS = {"kernel": "kernel", "feature": "env", "model": "model", "version": "version"}


def symbol_signatures(matches: DataFrame) -> DataFrame:
    """id, symbols: matched symbols (id, name, kind, weight, place) as the first layer of ``extract_signatures``."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SYMBOL_KINDS.items() for x in pair]), F.col("kind")), F.lit("op"))
    one = F.struct("place", F.struct(kind.alias("kind"), F.lower(strip(F.col("name"))).alias("text"), F.col("weight").cast("double").alias("weight"), F.concat(F.lit("symbol["), "kind", F.lit("]")).alias("origin")).alias("s"))
    per = matches.where(F.length("name") >= 3).groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("l"))
    return per.select("id", F.col("l.s").cast(SIGNATURE).alias("symbols"))


def extract_signatures(text: Column, rules: SignatureRules = RULES, symbols: Column | None = None, signals: Sequence[str] = ()) -> Column:
    """All layers, de-duplicated. ``symbols`` (of the signature type) takes the place of the first layer's expressions."""
    plain, low = F.coalesce(text, F.lit("")), F.lower(F.coalesce(text, F.lit("")))
    first = symbols if symbols is not None else reduce(lambda a, b: F.concat(a, b), [_found(plain, r) for r in rules.first])
    held = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, F.lower(w))) if words else F.array().cast("array<string>")
    return deduped(F.concat(first, parsed(plain, rules), _signatures(held(rules.phrases), "phrase", 2.0, "phrase"), _signatures(held(signals), "signal", 0.6, "signal")))
