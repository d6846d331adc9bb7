"""As-of joins on release dates.

A calendar is turned into spans between releases, and each span is put under the months that it touches. A row meets the
spans of its keys and month by an equi-join and lies in one of them at most. What lies after the last release (or before
the first) meets one row of its keys. So rows are never sorted, and those of one key are not gathered: the calendar's side
is small, and where it isn't, a skewed key of the rows can be split. There is one way for calendars of any size.

Releases without a key, tag or date count as not there; rows with a null key or time get no release.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def _calendar(calendar: DataFrame, keys: list[str], pick) -> DataFrame:
    """One release for each time of each key, with the times of its neighbours."""
    known = calendar.where("tag is not null and date is not null")
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    one = known.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("date").cast("timestamp").alias("_date")).agg(pick("tag").alias("_tag"))
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_date")
    return one.withColumn("_before", F.lag("_date").over(w)).withColumn("_after", F.lead("_date").over(w))


def _met(rows: DataFrame, at: Column, spans: DataFrame, edge: DataFrame, keys: list[str], inside: Column, beyond: Column, out: str) -> DataFrame:
    same = lambda side: [F.col(k) == F.col(f"{side}.{x}") for k, x in zip(keys, [f"_k{i}" for i in range(len(keys))], strict=True)]
    found = rows.withColumn("_at", at).withColumn("_month", _month(F.col("_at")))
    joined = found.join(spans.alias("_s"), [*same("_s"), F.col("_month") == F.col("_s._m"), inside], "left").join(edge.alias("_e"), [*same("_e"), beyond], "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("_s._tag", "_e._tag").alias(out))


def latest_before(rows: DataFrame, calendar: DataFrame, at: str, keys: list[str], out: str = "tag") -> DataFrame:
    """``rows`` with the tag of the last release (columns of ``keys``, tag, date) at or before ``at``; null if there is none.

    Of releases at one time the highest tag counts.
    """
    releases = _calendar(calendar, keys, F.max)
    spans = releases.where("_after is not null").withColumn("_m", F.explode(F.sequence(_month(F.col("_date")), _month(F.col("_after")))))
    edge = releases.where("_after is null")
    when = F.col("_at")
    return _met(rows, F.col(at).cast("timestamp"), spans, edge, keys, (F.col("_s._date") <= when) & (when < F.col("_s._after")), F.col("_e._date") <= when, out)


def first_after(rows: DataFrame, calendar: DataFrame, at: str, keys: list[str], out: str = "tag") -> DataFrame:
    """``rows`` with the tag of the first release at or after ``at``, both to the minute; the lowest tag of a minute counts."""
    releases = _calendar(calendar.withColumn("date", F.date_trunc("minute", "date")), keys, F.min)
    spans = releases.where("_before is not null").withColumn("_m", F.explode(F.sequence(_month(F.col("_before")), _month(F.col("_date")))))
    edge = releases.where("_before is null")
    when = F.col("_at")
    return _met(rows, F.date_trunc("minute", F.col(at)), spans, edge, keys, (F.col("_s._before") < when) & (when <= F.col("_s._date")), when <= F.col("_e._date"), out)


def enriched_span(docs: DataFrame, calendar: DataFrame, keys: list[str], resolved: str = "resolved_at", upper: str = "version_max") -> DataFrame:
    """``docs`` with an open upper version filled by the last release before their resolution."""
    found = latest_before(docs, calendar, resolved, keys, "_release")
    return found.withColumn(upper, F.coalesce(F.col(upper), "_release")).drop("_release")
