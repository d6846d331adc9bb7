"""Versions as structs of numbers; what can't be read is null, never compared as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how a version is found in a string.
VERSION = r"(\d+)\.(\d+)(?:\.(\d+))?"
#: Fixed value: suffixes of platform builds.
PLATFORM = r"(-openeuler|-310p|-a3|-a5|-a2)+$"


def version(text: Column) -> Column:
    """struct(major, minor, patch) of the first version in a string; a missing patch is 0."""
    part = lambda i: F.regexp_extract(text, VERSION, i)
    return F.when(text.rlike(VERSION), F.struct(part(1).try_cast("int").alias("major"), part(2).try_cast("int").alias("minor"), F.coalesce(F.nullif(part(3), F.lit("")).try_cast("int"), F.lit(0)).alias("patch")))


def version_distance(a: Column, b: Column) -> Column:
    """In minor versions: a major one counts ten, a patch a tenth."""
    return F.abs(a["major"] - b["major"]) * 10.0 + F.abs(a["minor"] - b["minor"]) + F.abs(a["patch"] - b["patch"]) * 0.1


def version_kind(tag: Column) -> Column:
    """rc, pre or release, by what the tag holds."""
    low = F.lower(tag)
    pre = low.contains("alpha") | low.contains("beta") | low.contains("dev") | low.contains("pre") | low.contains("post")
    return F.when(low.contains("rc"), "rc").when(pre, "pre").otherwise("release")


def base_version(tag: Column) -> Column:
    """A tag without the suffixes of platform builds."""
    return F.regexp_replace(tag, PLATFORM, "")


def plain_tag(tag: Column) -> Column:
    """Without a leading v."""
    return F.regexp_replace(tag, "^[vV]+", "")


def version_order(tag: Column) -> Column:
    """Sort key of a dotted tag: its parts as numbers."""
    return F.transform(F.split(plain_tag(tag), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
