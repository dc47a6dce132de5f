"""Scoring rules over columns. Time enters as as_of; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft import vocab


def lookup(key: Column, values: dict, default) -> Column:
    """values[key], or default."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole days, rounded down also for times ahead."""
    return F.floor(F.timestamp_diff("SECOND", ts, as_of) / 86400)


def trust_score(tier: Column) -> Column:
    return lookup(tier, vocab.TRUST_SCORE, vocab.TRUST_DEFAULT)


def impact_label(event_type: Column) -> Column:
    return lookup(event_type, vocab.IMPACT_BY_EVENT, vocab.IMPACT_DEFAULT)


def urgency(impact: Column, published_at: Column, as_of: Column) -> Column:
    recent = age_days(published_at, as_of) < 14
    dated = (
        F.when((impact == "Nghiêm trọng") & recent, "critical").when((impact == "Cao") & recent, "high")
        .when(impact.isin("Trung bình", "Cao"), "medium").otherwise("low")
    )
    undated = F.when(impact == "Nghiêm trọng", "critical").when(impact.isin("Cao", "Trung bình"), "medium").otherwise("low")
    return F.when(impact.isNull(), "low").when(published_at.isNull(), undated).otherwise(dated)


def relevance(language: Column, topics: Column) -> Column:
    local = F.array(*map(F.lit, vocab.LOCAL_TOPICS))
    return F.when((language == "vi") | F.array_contains(topics, vocab.LEGAL_TOPIC), "high").when(F.arrays_overlap(topics, local), "medium").otherwise("low")


def recency(published_at: Column, as_of: Column) -> Column:
    """Falls in a line over 30 days to a quarter, 0.1 beyond; a quarter without a date."""
    age = F.greatest(F.lit(0), age_days(published_at, as_of))
    return F.when(published_at.isNull(), 0.25).when(age <= 30, F.greatest(F.lit(0.1), 1 - age / 30.0 * 0.75)).otherwise(0.1)


def actionability(gate: Column, confidence: Column, trust: Column, event_type: Column, published_at: Column, as_of: Column) -> Column:
    weight = lookup(event_type, vocab.EVENT_WEIGHT, vocab.EVENT_WEIGHT_DEFAULT)
    total = 0.25 * gate + 0.20 * confidence + 0.15 * trust + 0.25 * weight + 0.15 * recency(published_at, as_of)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4)


def tier(score: Column, event_type: Column) -> Column:
    tactical = event_type.isin(*vocab.TACTICAL_EVENTS)
    return (
        F.when(tactical & (score >= 0.6), "Tactical").when(tactical & (score >= 0.4), "Operational").when(event_type.isin(*vocab.STRATEGIC_EVENTS), "Strategic")
        .when(score >= 0.5, "Operational").otherwise("Informational")
    )


def momentum(size: Column, age: Column) -> Column:
    """Of a cluster by its size and the age of its earliest item in days."""
    return F.when((size <= 1) & (age < 3), "new").when((size >= 3) & (age < 7), "rising").otherwise("mature")


def valid_roles(roles: Column) -> Column:
    """Roles of the closed set, order and repeats kept; null to empty."""
    allowed = F.array(*map(F.lit, vocab.ROLES))
    return F.filter(F.coalesce(roles, F.array().cast("array<string>")), lambda r: F.array_contains(allowed, r))


def valid_recommendations(recs: Column, roles: Column) -> Column:
    """map<role, struct<action_type, note, urgency>>: entries of affected roles with a known action and a note; odd urgency is medium; empty is null."""
    kept = F.map_filter(recs, lambda role, r: F.array_contains(roles, role) & r["action_type"].isin(*vocab.ACTION_TYPES) & (F.trim(F.coalesce(r["note"], F.lit(""))) != ""))
    mended = F.transform_values(kept, lambda _, r: F.struct(r["action_type"].alias("action_type"), F.trim(r["note"]).alias("note"), F.when(r["urgency"].isin(*vocab.ROLE_URGENCY), r["urgency"]).otherwise("medium").alias("urgency")))
    return F.when(F.size(mended) > 0, mended)


def valid_ring(ring: Column) -> Column:
    return F.when(ring.isin(*vocab.ADOPTION_RINGS), ring)


def role_urgency(recs: Column, role: Column) -> Column:
    return F.when(F.try_element_at(recs, role)["urgency"].isin(*vocab.ROLE_URGENCY), F.try_element_at(recs, role)["urgency"]).otherwise("medium")


def is_practical(indicators: Column) -> Column:
    out = F.lit(False)
    for k in vocab.PRACTICAL:
        out = out | F.coalesce(F.try_element_at(indicators, F.lit(k)), F.lit(False))
    return out


def importance(item, role: Column) -> Column:
    """The seven-part key of an item for a role; larger is more important. item: a function from name to column."""
    when = F.coalesce(item("published_at"), item("created_at"))
    return F.struct(
        lookup(role_urgency(item("recommendations"), role), vocab.ROLE_URGENCY_RANK, 2).alias("a"),
        lookup(item("impact_label"), vocab.IMPACT_RANK, 0).alias("b"),
        is_practical(item("indicators")).cast("int").alias("c"),
        F.coalesce(item("score"), F.lit(0.0)).alias("d"),
        F.coalesce((item("tier") == "Strategic").cast("int"), F.lit(0)).alias("e"),
        F.coalesce(item("trust_score"), F.lit(0.0)).alias("f"),
        F.coalesce(F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01'"), when), F.lit(0)).alias("g"),
    )


def importance_over(item, asked: Column) -> Column:
    """The largest importance() of an item over the asked roles; without any over those it affects, without these for the whole company."""
    roles = F.coalesce(F.when(F.size(asked) > 0, asked), F.when(F.size(item("roles")) > 0, item("roles")), F.array(F.lit(vocab.COMPANY_WIDE)))
    return F.array_max(F.transform(roles, lambda role: importance(item, role)))


def gate_status(passed: Column, failed: Column, content: Column, confidence: Column) -> Column:
    """Where a document goes: empty or unsure to failed, not passed to low_signal; an error of the gate lets it pass."""
    return (
        F.when(F.trim(F.coalesce(content, F.lit(""))) == "", "failed").when(~F.coalesce(failed, F.lit(False)) & ~F.coalesce(passed, F.lit(False)), "low_signal")
        .when(confidence < vocab.MIN_CONFIDENCE, "failed").otherwise("analyzed")
    )


def gate_score(score: Column, failed: Column) -> Column:
    return F.when(F.coalesce(failed, F.lit(False)), 0.5).otherwise(score)


def remapped_topics(topics: Column) -> Column:
    """Old names to new ones, unknown ones out, first occurrences kept; a default where none is left."""
    names = F.create_map(*[F.lit(x) for kv in vocab.TOPIC_REMAP.items() for x in kv])
    allowed = F.array(*map(F.lit, vocab.TOPICS))
    new = F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.coalesce(F.try_element_at(names, t), t))
    kept = F.array_distinct(F.filter(new, lambda t: F.array_contains(allowed, t)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(vocab.DEFAULT_TOPIC)))


def remapped_event(event_type: Column) -> Column:
    out = event_type
    for old, new in vocab.EVENT_REMAP.items():
        out = F.when(event_type == old, F.lit(new)).otherwise(out)
    return out


def relative_time(ts: Column, as_of: Column) -> Column:
    minutes = F.floor(F.timestamp_diff("SECOND", ts, as_of) / 60)
    return (
        F.when(ts.isNull(), "").when(minutes < 1, "now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" d")))
    )
