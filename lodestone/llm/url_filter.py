"""URL filters: rules are regular expressions, each indexed by the rarest literal token that it needs.

A url is reduced to its host (A-Z lower-cased) and path; its tokens are their runs of letters and figures. Which tokens
all matches of a rule must hold is read off its expression (``rule_tokens``): a token alone, or one of several. How rare
they are is counted over the whole table, and each rule is put into the index under its rarest. The index is a table of
(token, rule); the tokens of a url fetch candidate rules by a join, and only those rules' expressions run. Rules that
need no token are candidates of every url.

All of it is DataFrame functions. Rules are a table in the shared folder, whose size Spark knows when it picks the join.
What is shuffled is token counts, and the candidates' verdicts: one for each different host and path that a rule fits.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and the default verdict. Repeated
rows are judged each; ids may be of any type. A tie of two site rules of one length goes to the one that is listed later;
of pattern rules the first listed decides. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: More strings than this are not told apart.
MOST = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is searched in host + path.

    A site rule has the ``name`` that is reported, and the longest name wins; pattern rules (no name) decide after those.
    """

    verdict: str
    pattern: str
    name: str | None = None


def site_rule(verdict: str, name: str) -> UrlRule:
    """A rule like ``example.net/en/``: the host and its subdomains, and paths that start so."""
    return UrlRule(verdict, rf"^(?:[^/]*\.)?{re.escape(name)}", name)


#: The site rules of the contract.
SITE_RULES = (site_rule("block", "net/"), site_rule("allow", "example.net/en/"), site_rule("block", "example.com/de/"), site_rule("allow", "org/fr/"))

#: Pattern rules for hosts that no site rule knows.
PATTERN_RULES = (
    UrlRule("block", r"^(?:[^/]*\.)?spam-[a-z0-9]+\."),
    UrlRule("block", r"^(?:[^/]*[.-])?casino[.-]"),
    UrlRule("block", r"^(?:[^/]*\.)?(?:ads|adserver)[.-]"),
    UrlRule("block", r"^(?:[^/]*[.-])?xxx[.-]"),
    UrlRule("block", r"/wp-admin/"),
    UrlRule("block", r"/cgi-bin/"),
    UrlRule("block", r"^(?:[^/]*[.-])?tracker[.-]"),
)


def _is_token(c: str) -> bool:
    return c.isascii() and c.isalnum()


@dataclass
class _Atom:
    """A piece of an expression: its strings if they are few, else how it may begin and end: ``parts`` where the first
    (last) character is none of a token's, ``empty`` where it may match nothing."""

    strings: set[str] | None
    begins: bool = False
    ends: bool = False
    empty: bool = False


def _of_strings(strings: set[str]) -> _Atom:
    return _Atom(strings, all(not _is_token(x[0]) for x in strings if x), all(not _is_token(x[-1]) for x in strings if x), "" in strings)


def _opaque(parts: bool = False, empty: bool = False) -> _Atom:
    return _Atom(None, parts, parts, empty)


def _members(items) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            found.add(chr(value))
        elif str(op) == "RANGE" and value[1] - value[0] < MOST:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found


def _atoms(node) -> list[_Atom]:
    """The pieces of a sequence."""
    out = []
    for op, value in node:
        name = str(op)
        if name == "LITERAL":
            out.append(_of_strings({chr(value).lower()}))
        elif name == "IN":
            found = _members(value)
            out.append(_opaque() if found is None else _of_strings({c.lower() for c in found}))
        elif name == "AT":
            out.append(_opaque(parts=str(value) in ("AT_BEGINNING", "AT_BEGINNING_STRING", "AT_END", "AT_END_STRING"), empty=str(value) not in ("AT_BEGINNING", "AT_BEGINNING_STRING", "AT_END", "AT_END_STRING")))
        elif name == "SUBPATTERN":
            out.append(_whole(_atoms(value[-1])))
        elif name == "BRANCH":
            sides = [_whole(_atoms(x)) for x in value[1]]
            few = all(x.strings is not None for x in sides)
            out.append(_of_strings(set().union(*(x.strings for x in sides))) if few else _Atom(None, all(x.begins for x in sides), all(x.ends for x in sides), any(x.empty for x in sides)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            one = _whole(_atoms(inner))
            if one.strings is not None and (least, int(most)) in ((0, 1), (1, 1)):
                out.append(_of_strings(one.strings | ({""} if not least else set())))
            else:
                out.append(_Atom(None, one.begins, one.ends, one.empty or not least))
        elif name not in ("ASSERT", "ASSERT_NOT"):
            out.append(_opaque())
    return out


def _whole(atoms: list[_Atom]) -> _Atom:
    """A sequence as one piece."""
    if all(x.strings is not None for x in atoms):
        many = 1
        for x in atoms:
            many *= len(x.strings)
        if many <= MOST:
            return _of_strings({"".join(x) for x in product(*(x.strings for x in atoms))})

    def edge(order, side: str) -> bool:
        for x in order:
            if not getattr(x, side):
                return False
            if not x.empty:
                return True
        return False  # what stands beside the sequence shows

    return _Atom(None, edge(atoms, "begins"), edge(atoms[::-1], "ends"), all(x.empty for x in atoms))


def rule_tokens(pattern: str) -> list[list[str]]:
    """Groups of tokens: all that ``pattern`` matches has one of each group as a whole token. None, if it needs none."""
    atoms = _atoms(_parser.parse(pattern))
    groups: set[tuple[str, ...]] = set()
    i = 0
    while i < len(atoms):
        j, strings = i, {""}
        while j < len(atoms) and atoms[j].strings is not None and len(strings) * len(atoms[j].strings) <= MOST:
            strings, j = {a + b for a, b in product(strings, atoms[j].strings)}, j + 1
        if j == i:
            i += 1
            continue
        left, right = _parted(atoms[:i][::-1], "ends"), _parted(atoms[j:], "begins")
        kept = []
        for x in sorted(strings):
            runs = re.split("[^a-z0-9]", x)
            kept.append([t for k, t in enumerate(runs) if t and (k or left) and (k < len(runs) - 1 or right)])
        if len(kept) == 1:
            groups |= {(t,) for t in kept[0]}
        elif all(kept):
            groups.add(tuple(sorted({max(k, key=lambda t: (len(t), t)) for k in kept})))
        i = j
    return [list(g) for g in sorted(groups)]


def _parted(beside: list[_Atom], side: str) -> bool:
    """Whether what stands beside a piece surely parts it from other letters and figures."""
    for x in beside:
        if not getattr(x, side):
            return False
        if not x.empty:
            return True
    return False


def _parts(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), "^([^?#]*)", 1)


RULE = "rule int, site int, size int, name string, verdict string, pattern string, groups array<array<string>>"


def _rule_table(spark: SparkSession, site_rules: Sequence[UrlRule], pattern_rules: Sequence[UrlRule]) -> DataFrame:
    """The rules in order of precedence: site rules by length of name, then pattern rules as listed."""
    rows = [(i, 1, len(r.name), r.name, r.verdict, r.pattern, rule_tokens(r.pattern)) for i, r in enumerate(site_rules)]
    rows += [(len(rows) + i, 0, -i, None, r.verdict, r.pattern, rule_tokens(r.pattern)) for i, r in enumerate(pattern_rules)]
    return materialise(spark.createDataFrame(rows, RULE), "url-rules")


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """token, rule: each rule under the tokens of its rarest group over ``urls`` (column tokens), or under "" if it has none."""
    group = rules.select("rule", F.posexplode("groups").alias("g", "tokens")).select("rule", "g", F.explode("tokens").alias("token"))
    met = urls.select(F.explode("tokens").alias("token")).join(group.select("token").distinct(), "token").groupBy("token").count()
    weight = group.join(met, "token", "left").groupBy("rule", "g").agg(F.sum(F.coalesce("count", F.lit(0))).alias("n"))
    rarest = weight.groupBy("rule").agg(F.min(F.struct("n", "g"))["g"].alias("g"))
    return group.join(rarest, ["rule", "g"]).select("token", "rule").union(rules.where(F.size("groups") == 0).select(F.lit("").alias("token"), "rule"))


def filter_urls(
    pages: DataFrame, site_rules: Sequence[UrlRule] = SITE_RULES, pattern_rules: Sequence[UrlRule] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """page_id, host, path, rule and verdict of every url; ``method`` says what decided (site, pattern or default)."""
    host, path = _parts(F.col("url"))
    split = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    urls = split.select("host", "path", F.array_distinct(F.split(F.translate(F.concat("host", "path"), UPPER, LOWER), "[^a-z0-9]+")).alias("tokens"))
    if not (site_rules or pattern_rules):
        return split.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit("default").alias("method"))
    rules = _rule_table(pages.sparkSession, site_rules, pattern_rules)
    index = materialise(rule_index(urls, rules).join(rules.drop("groups"), "rule"), "url-index")
    # a url without tokens has "" among them already
    fetched = urls.select("host", "path", F.explode(F.array_distinct(F.concat("tokens", F.array(F.lit(""))))).alias("token")).join(index, "token")
    fits = fetched.where(F.rlike(F.concat("host", "path"), F.col("pattern")))
    best = fits.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.max(F.struct("site", "size", "rule", "name", "verdict")).alias("best"))
    return split.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").select(
        "page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("best").isNull(), "default").when(F.col("best.site") == 1, "site").otherwise("pattern").alias("method"),
    )


def oracle_sql(site_rules: Sequence[UrlRule] = SITE_RULES, pattern_rules: Sequence[UrlRule] = PATTERN_RULES, default: str = "allow") -> str:
    """The same over the view ``pages``, every rule tried on every url."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = lambda rules, what: "CASE " + " ".join(f"WHEN regexp_matches(host || path, {quote(r.pattern)}) THEN {quote(what(r))}" for r in rules) + " END"
    longest = sorted(site_rules, key=lambda r: -len(r.name))
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, regexp_extract(r, '^([^/?#]*)', 1) AS raw, r FROM rest),
split AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(r, length(raw) + 1), '^([^?#]*)', 1) AS path FROM parts),
fit AS (SELECT *, {cases(longest, lambda r: r.name)} AS rule, {cases(longest, lambda r: r.verdict)} AS site, {cases(pattern_rules, lambda r: r.verdict)} AS pattern FROM split)
SELECT page_id, host, path, rule, coalesce(site, pattern, '{default}') AS verdict,
  CASE WHEN site IS NOT NULL THEN 'site' WHEN pattern IS NOT NULL THEN 'pattern' ELSE 'default' END AS method FROM fit"""
