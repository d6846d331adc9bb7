"""Raw issues and change requests into canonical documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.references import source_id
from ..functions.text import strip

#: Headings of the environment part, prefixes of titles, a version in a label.
ENVIRONMENT = ("### your current environment", "## your current environment", "<summary>environment</summary>")
KINDS = ("bug", "fix", "doc", "feature", "rfc")
LABEL_VERSION = r"v?(0\.\d+(?:\.\d+)?)"
ENVIRONMENT_CHARS = 4000


def environment_start(body: Column) -> Column:
    """Where the first environment heading stands, from 1; null if there is none."""
    return F.least(*[F.nullif(F.instr(F.lower(body), m), F.lit(0)) for m in ENVIRONMENT])


def semantic_body(body: Column) -> Column:
    at = environment_start(body)
    return F.when(at.isNull(), strip(body)).otherwise(strip(body.substr(F.lit(1), at - 1)))


def environment(body: Column) -> Column:
    at = environment_start(body)
    return F.when(at.isNull(), F.lit("")).otherwise(F.substring(strip(body.substr(at, F.length(body))), 1, ENVIRONMENT_CHARS))


def title_kind(title: Column) -> Column:
    """By the bracketed prefix of a title."""
    low = F.lower(strip(F.coalesce(title, F.lit(""))))
    out = F.lit("other")
    for k in KINDS:
        out = F.when(F.startswith(low, F.lit(f"[{k}]")), k).otherwise(out)
    return out


def label_version(labels: Column) -> Column:
    """Of the first label that names one."""
    return F.get(F.filter(F.transform(labels, lambda x: F.regexp_extract(x, LABEL_VERSION, 1)), lambda v: v != ""), F.lit(0))


def component_versions(text: Column, specs: Mapping[str, tuple[Sequence[str], str]]) -> Column:
    """map of component to the first version after one of its names; longer names first.

    ``specs``: component to its names and the form of its versions.
    """
    one = {}
    for name, (aliases, form) in specs.items():
        tries = []
        for alias in sorted(aliases, key=len, reverse=True):
            escaped = "".join("\\" + ch if not ch.isalnum() else ch for ch in alias)
            pattern = rf"(?i)(?<![A-Za-z0-9_\-]){escaped}(?:\s+version\s*)?[\s:=_\-*`]*v?({form})"
            tries.append(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit("")))
        one[name] = F.coalesce(*tries, F.lit(None).cast("string"))
    return F.map_filter(F.create_map(*[x for k, v in one.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def threads(comments: DataFrame, key: str, order: str) -> DataFrame:
    """key, thread, n: ``### login (time):`` and body of each comment in order, parted by blank lines."""
    part = F.concat(F.lit("### "), F.coalesce("login", F.lit("unknown")), F.lit(" ("), F.coalesce("created_at", F.lit("")), F.lit("):\n"), F.coalesce("body", F.lit("")))
    per = comments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))).alias("l"))
    return per.select(key, F.array_join(F.col("l.p"), "\n\n").alias("thread"), F.size("l").alias("n"))


def canonical_documents(items: DataFrame, comments: DataFrame, repo: str, component: str, specs: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Documents of raw items (number, title, body, labels, state, created_at, updated_at, closed_at, html_url, is_pr, merged, merged_at).

    Only issues take versions from their text; of requests the labels alone are trusted.
    """
    joined = items.join(threads(comments, "number", "position"), "number", "left")
    body = semantic_body(F.coalesce("body", F.lit("")))
    whole = F.when(F.col("thread").isNull(), body).otherwise(F.concat(body, F.lit("\n\n---\n\n"), F.col("thread")))
    versions = F.when(~F.col("is_pr"), component_versions(F.col("body"), specs)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    state = F.when(F.col("state") == "closed", "closed").otherwise("open")
    return joined.select(
        F.when(F.col("is_pr"), "github_pr").otherwise("github_issue").alias("source_type"),
        source_id(F.lit(repo), F.when(F.col("is_pr"), "pr").otherwise("issue"), F.col("number")).alias("source_id"),
        F.coalesce(F.nullif("html_url", F.lit("")), F.concat(F.lit(f"https://github.com/{repo}/issues/"), F.col("number").cast("string"))).alias("url"),
        F.coalesce("title", F.lit("")).alias("title"), whole.alias("body"), "created_at", "updated_at",
        F.when(F.col("is_pr"), F.coalesce("merged_at", "closed_at")).otherwise(F.col("closed_at")).alias("resolved_at"),
        F.when(F.col("is_pr") & F.coalesce("merged", F.lit(False)), "merged").otherwise(state).alias("status"),
        "labels", F.coalesce(label_version(F.col("labels")), F.try_element_at(versions, F.lit(component))).alias("version_min"), F.lit(None).cast("string").alias("version_max"),
        F.lit(component).alias("component"), F.map_filter(versions, lambda k, _: k != component).alias("component_versions"),
        title_kind(F.col("title")).alias("kind"), F.when(F.col("is_pr"), F.col("merged_at")).alias("merged_at"), environment(F.coalesce("body", F.lit(""))).alias("environment"), F.coalesce("n", F.lit(0)).alias("comment_count"),
    )


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of lowest ``order`` of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def new_rows(incoming: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What an append adds: keys that aren't there yet."""
    return incoming.join(present.select(key).distinct(), key, "left_anti")
