"""Small parsers: versions in bodies, default components, references and queries as users write them, tags, text forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .references import source_id
from .text import strip

#: Fixed values: ``component:version rest``, and tags of builds that change.
COMPONENT_QUERY = r"(?s)^\s*([A-Za-z0-9_\-]+)\s*:\s*([A-Za-z0-9][A-Za-z0-9._\-]*)\s+(.+)$"
MOVING = r"(?i)(^|[-_])(nightly|ntightly|daily)([-_]|$)|(^|[-_])releases([-_]|$)|(^|[-_])(main|latest|develop|master|dev)([-_]|$)"


def escaped(name: str) -> str:
    """A name as an expression that both Java and Python take literally."""
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in name)


def _some(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def body_version(body: Column, product: str) -> Column:
    """The version that a report names: in the field of its form, else a whole one after the product's name; null if none."""
    text, name = F.coalesce(body, F.lit("")), escaped(product)
    return F.coalesce(_some(text, rf"(?i){name}\s+version[^0-9]*(\d+\.\d+(?:\.\d+)?)"), _some(text, rf"(?i)\b{name}[\s:=_\-]*v?(\d+\.\d+\.\d+)"))


def default_component(repo: Column, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The component of the first rule (parts of a name, component) whose part the repository's name has, else the name itself."""
    slug = F.lower(F.coalesce(repo, F.lit("")))
    out = F.coalesce(F.nullif(F.replace(slug, F.lit("/"), F.lit("-")), F.lit("")), F.lit("doc"))
    for parts, component in reversed(rules):
        held = F.lit(False)
        for p in parts:
            held = held | F.contains(slug, F.lit(p))
        out = F.when(held, component).otherwise(out)
    return out


def repository(name: Column, aliases: Mapping[str, str], default: str | None = None) -> Column:
    """A repository by its short name; what is no alias stays, and nothing is the default."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), name) if aliases else F.lit(None).cast("string")
    given = F.coalesce(known, F.nullif(name, F.lit("")))
    return given if default is None else F.coalesce(given, F.lit(default))


def document_reference(text: Column, kind: str, aliases: Mapping[str, str]) -> Column:
    """The id that ``repo#number`` stands for; an id, or anything else, stays as it is."""
    repo, number = F.regexp_extract(text, r"^(.*)#([^#]*)$", 1), F.regexp_extract(text, r"^(.*)#([^#]*)$", 2)
    short = F.contains(text, F.lit("#")) & ~F.startswith(text, F.lit("github:"))
    return F.when(short, source_id(repository(repo, aliases), kind, number)).otherwise(text)


def component_query(query: Column) -> Column:
    """struct(component, version, rest) of ``component:version rest``; without that prefix the first two are null."""
    return F.struct(
        _some(query, COMPONENT_QUERY, 1).alias("component"), _some(query, COMPONENT_QUERY, 2).alias("version"),
        strip(F.coalesce(_some(query, COMPONENT_QUERY, 3), query)).alias("rest"),
    )


def parse_time(text: Column) -> Column:
    """An ISO time; null where it can't be read."""
    return F.try_to_timestamp(text)


def is_managed(tag: Column) -> Column:
    """Whether a tag stays: no daily build, branch, trunk or development build."""
    return ~tag.rlike(MOVING)


def moving_category(tag: Column) -> Column:
    """What kind of moving build a tag is."""
    low = F.lower(tag)
    trunk = low.isin("latest", "develop", "master") | F.startswith(low, F.lit("main")) | F.startswith(low, F.lit("latest"))
    return (
        F.when(low.rlike("nightly|ntightly|daily"), "nightly")
        .when(F.startswith(low, F.lit("releases")) | F.contains(low, F.lit("-releases")), "branch")
        .when(trunk, "trunk")
        .when(F.startswith(low, F.lit("dev")) | low.rlike("[-_]dev"), "dev")
        .otherwise("other")
    )


def hit_line(place: Column, title: Column, final: Column, confidence: Column, url: Column) -> Column:
    """A search hit as a line of text."""
    return F.format_string("%d. [%.3f] %s (confidence %.3f) %s", place, final, F.coalesce(title, F.lit("")), confidence, F.coalesce(url, F.lit("")))


def signature_line(signature: Column) -> Column:
    """A signature (kind, text, weight, origin) as a line of text."""
    return F.format_string("[%s] %s (weight %.1f, from %s)", signature["kind"], signature["text"], signature["weight"], signature["origin"])


def time_text(at: Column) -> Column:
    """A time to the second, in UTC if the session is; empty for null."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def code_line(version: Column, path: Column, line: Column, text: Column) -> Column:
    """A line of source as text: where it is, and what it says without white space at its ends."""
    return F.format_string("[%s] %s:%d: %s", F.coalesce(version, F.lit("-")), path, line, strip(F.coalesce(text, F.lit(""))))


def version_line(tag: Column, kind: Column, match: Column, date: Column) -> Column:
    """What a release calendar says of a tag, as text; ``match`` is exact, plain or none."""
    known = F.format_string("%s = %s (%s)", tag, kind, F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("-")))
    return F.when(match == "none", F.format_string("%s: not in the calendar (%s)", tag, kind)).otherwise(known)


def chain_line(issue: Column, request: Column, tag: Column, date: Column) -> Column:
    """A fix of an issue as text: which request, and the release that has it, if one has."""
    out = F.format_string("in %s (%s)", tag, F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("-")))
    return F.format_string("%s <- %s %s", issue, request, F.coalesce(F.when(tag.isNotNull(), out), F.lit("not released")))
