"""References between documents, and names of interfaces and codes in manuals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signatures import ACL_CODE
from .text import strip

#: How a text says that it fixes something, or what fixed it.
FIX_VERB = r"(?:fix(?:es|ed)?|close(?:s|d)?|resolve(?:s|d)?|address(?:es|ed)?)"
FIXES = rf"(?i)\b{FIX_VERB}\s+(?:issue\s+|bug\s+)?#(\d+)\b"
FIXES_IN = rf"(?i)\b{FIX_VERB}\s+(?:https?://github\.com/)?([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)#(\d+)\b"
FIXED_BY = r"(?i)(?:fixed|fix|closed|resolved)\s+by\s+#(\d+)\b"
#: Command forms, flags that are no commands, images, and which signatures are entities.
COMMAND = r"命令格式\s*\n\s*([a-z][a-z0-9_-]{1,31})(?:\s*\[[^\]]*\])*(?:\s+-([a-z][a-z0-9_-]*))?"
ACTIONS = ("g", "s", "h", "i")
IMAGE = r"""!\[([^\]]*)\]\(([^)\s]+)(?:\s+["'][^"']*["'])?\)"""
ENTITY_KINDS = {"kernel": "operator", "op": "operator", "errcode": "error_code", "model": "model", "version": "version"}
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]{2,63}$"


def _numbers(text: Column, pattern: str, group: int) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group)), lambda n: n.try_cast("bigint")), lambda n: n.isNotNull())


def fix_references(text: Column, repo: Column) -> Column:
    """array<struct<repo,number>> of what a text says that it fixes, in its own repository or another."""
    same = F.transform(_numbers(text, FIXES, 1), lambda n: F.named_struct(F.lit("repo"), repo, F.lit("number"), n))
    names, numbers = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIXES_IN), F.lit(g)) for g in (1, 2))
    cross = F.zip_with(names, numbers, lambda r, n: F.named_struct(F.lit("repo"), r, F.lit("number"), n.try_cast("bigint")))
    kind = "array<struct<repo:string,number:bigint>>"
    return F.array_sort(F.array_distinct(F.concat(same.cast(kind), cross.cast(kind))))


def fixed_by_references(text: Column, repo: Column) -> Column:
    """array<struct<repo,number>> of what fixed the document, as its own text says."""
    return F.array_sort(F.array_distinct(F.transform(_numbers(text, FIXED_BY, 1), lambda n: F.named_struct(F.lit("repo"), repo, F.lit("number"), n))))


def source_id(repo: Column, kind: Column | str, number: Column) -> Column:
    """The id of an issue or a change request of a repository."""
    return F.concat(F.lit("github:"), F.replace(repo, F.lit("/"), F.lit("-")), F.lit(":"), F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), number.cast("string"))


def interfaces(text: Column) -> Column:
    """tool.subcommand of each command form that a manual defines; bare tools and action flags are left out."""
    tools, subs = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(COMMAND), F.lit(g)) for g in (1, 2))
    both = F.filter(F.arrays_zip(tools.alias("tool"), subs.alias("sub")), lambda s: (F.length(s["sub"]) > 1) & ~F.lower(s["sub"]).isin(*ACTIONS))
    return F.array_distinct(F.transform(both, lambda s: F.concat(s["tool"], F.lit("."), F.lower(s["sub"]))))


def error_codes(text: Column) -> Column:
    """The different error codes of a text, in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ACL_CODE), F.lit(1)))


def resolved_images(text: Column, known: Column) -> Column:
    """A Markdown text in which each local image that ``known`` (map of reference to stored name) has points to its stored copy."""
    refs = F.filter(image_references(text), lambda r: (r["kind"] == "local") & F.map_contains_key(known, r["ref"]))
    swap = lambda acc, r: F.replace(acc, F.concat(F.lit("]("), r["ref"]), F.concat(F.lit("]("), F.element_at(known, r["ref"])))
    return F.aggregate(refs, F.coalesce(text, F.lit("")), swap)


def clean_entity(value: Column) -> Column:
    """One line without quotes, commas or backslashes."""
    return F.translate(F.regexp_replace(F.regexp_replace(strip(value), "^[\"']+|[\"']+$", ""), r"(?U)\s+", " "), "\\,\"'", "____")


def mentions(signatures: Column) -> Column:
    """array<struct<kind,name>> of the entities among signatures; operators must look like identifiers."""
    kind = F.create_map(*[F.lit(x) for pair in ENTITY_KINDS.items() for x in pair])
    named = F.transform(signatures, lambda s: F.named_struct(F.lit("kind"), F.try_element_at(kind, s["kind"]), F.lit("name"), clean_entity(s["text"])))
    return F.array_sort(F.array_distinct(F.filter(named, lambda s: s["kind"].isNotNull() & (F.length(s["name"]) >= 3) & ((s["kind"] != "operator") | s["name"].rlike(IDENTIFIER)))))


def image_references(text: Column) -> Column:
    """array<struct<alt,ref,kind>> of a Markdown text's images: remote, base64, unresolved data, or local."""
    alts, refs = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IMAGE), F.lit(g)) for g in (1, 2))
    kind = lambda r: (
        F.when(r.startswith("http://") | r.startswith("https://"), "remote")
        .when(r.rlike(r"(?i)^data:image/(png|jpe?g|webp|gif);base64,[A-Za-z0-9+/=]+"), "base64")
        .when(r.startswith("data:"), "unresolved")
        .otherwise("local")
    )
    return F.zip_with(alts, refs, lambda a, r: F.named_struct(F.lit("alt"), a, F.lit("ref"), r, F.lit("kind"), kind(r)))
