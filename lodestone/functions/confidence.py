"""Query-time confidence of a document: how recent, how fit for a version, how reliable. ``now`` is always given."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .versions import version_distance


@dataclass(frozen=True)
class Confidence:
    """The default weights."""

    half_life_days: float = 365.0
    time_floor: float = 0.15
    sigma: float = 1.5
    unknown_version: float = 0.5
    alpha: float = 0.6
    beta: float = 0.4
    gamma: float = 0.6
    reliability: Mapping[str, float] = field(default_factory=lambda: {"official_doc": 0.85, "wiki": 0.7, "discussion": 0.5, "merged_fix": 0.9, "closed": 0.6, "open": 0.4})
    kinds: Mapping[str, float] = field(default_factory=lambda: {"doc": 0.6, "feature": 0.7, "rfc": 0.7})
    verification: Mapping[str, float] = field(default_factory=lambda: {"expert": 0.95, "tested": 0.85, "unverified": 0.5})


DEFAULT = Confidence()


def time_weight(created: Column, resolved: Column, now: Column, c: Confidence = DEFAULT) -> Column:
    """Halves each half-life from the resolution on (else from creation), down to a floor; 1 without dates."""
    since = F.coalesce(resolved, created)
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(since)) / F.lit(86_400e6))
    return F.when(since.isNull(), F.lit(1.0)).otherwise(F.lit(c.time_floor) + F.lit(1 - c.time_floor) * F.pow(F.lit(2.0), -days / F.lit(c.half_life_days)))


def version_weight(low: Column, high: Column, target: Column, c: Confidence = DEFAULT) -> Column:
    """1 within the span (an end may be open), else less by the distance to it; all are version structs."""
    decay = lambda end: F.pow(F.lit(2.0), -version_distance(target, end) / F.lit(c.sigma)) if c.sigma > 0 else F.lit(0.0)
    return (
        F.when(target.isNull() | (low.isNull() & high.isNull()), F.lit(c.unknown_version))
        .when(low.isNotNull() & (target < low), decay(low))
        .when(high.isNotNull() & (target > high), decay(high))
        .otherwise(F.lit(1.0))
    )


def _lookup(key: Column, table: Mapping[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def reliability(source_type: Column, status: Column, resolved: Column, kind: Column, verification: Column, explicit: Column | None = None, c: Confidence = DEFAULT) -> Column:
    """By kind of source and state; feedback kinds count less, a verified document has a floor; ``explicit`` overrides."""
    r = {k: F.lit(float(v)) for k, v in c.reliability.items()}
    issue = F.when(status == "merged", r["merged_fix"]).when((status == "closed") & resolved.isNotNull(), r["closed"]).otherwise(r["open"])
    base = (
        F.when(source_type.isin("doc", "official_doc", "release_note"), r["official_doc"])
        .when(source_type == "wiki", r["wiki"])
        .when(source_type == "discussion", r["discussion"])
        .when(source_type.isin("github_issue", "github_pr"), issue * F.coalesce(_lookup(kind, c.kinds), F.lit(1.0)))
        .otherwise(r["open"])
    )
    base = F.greatest(base, F.coalesce(_lookup(verification, c.verification), base))
    return base if explicit is None else F.coalesce(explicit, base)


def confidence(w_time: Column, w_version: Column, w_reliability: Column, c: Confidence = DEFAULT) -> Column:
    return w_time * (F.lit(c.alpha) * w_version + F.lit(c.beta) * w_reliability)


def final_score(similarity: Column, conf: Column, c: Confidence = DEFAULT) -> Column:
    """similarity^gamma * confidence^(1 - gamma), both held to 0..1."""
    s, k = (F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) for x in (similarity, conf))
    return F.pow(s, F.lit(c.gamma)) * F.pow(k, F.lit(1 - c.gamma))
