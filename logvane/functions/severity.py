"""Severity tiers and everything worded from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logvane.functions.coerce import finite

# Tiers from least to most urgent with their lowest score.
TIER_FLOORS = {"low": 0.0, "medium": 0.25, "high": 0.5, "critical": 0.75}
SEVERITIES = tuple(TIER_FLOORS)

# Weight of each tier in the threat index.
SEVERITY_WEIGHTS = {"critical": 100, "high": 70, "medium": 40, "low": 20, "none": 0}

# Lowest threat index of each label.
THREAT_LABELS = {"CRITICAL": 75, "HIGH": 50, "ELEVATED": 25, "LOW": 0}

# What an analyst is told to do.
RECOMMENDED_ACTIONS = {
    "critical": "Isolate affected host, capture full packet detail, and escalate to "
    "Tier-2 immediately.",
    "high": "Review source/destination context, correlate with recent events, and "
    "prepare containment.",
    "medium": "Monitor for repetition; add to watchlist if pattern recurs.",
}
DEFAULT_ACTION = (
    "Low priority — log for baseline tuning and false-positive review."
)

# Attack label (lower case) and the technique it stands for.
TECHNIQUES = {
    "portscan": "Network Service Scan",
    "ftp-patator": "Brute Force",
    "ssh-patator": "Brute Force",
    "bot": "Command & Scripting",
    "ddos": "Exploitation",
    "dos hulk": "Exploitation",
    "infiltration": "Valid Accounts",
}

# The sentences of the alert narrative.
NARRATIVE_NORMAL = (
    "This flow scored %s, within the learned benign baseline — no anomaly flagged."
)
NARRATIVE_ALERT = (
    "This traffic deviates from the benign baseline. The Isolation Forest isolated it "
    "with an anomaly score of %s. Its largest deviations from normal are %s — the "
    "features sitting furthest from the baseline learned on benign flows. These "
    "highlight where the traffic is unusual; they are an analyst signal, not the "
    "model's internal reason for isolating it. Classified %s at %s severity."
)
NARRATIVE_NO_FEATURES = "spread across several features"


def check_severity(tier: str) -> str:
    if tier not in TIER_FLOORS:
        raise ValueError(f"unknown severity {tier!r}; expected one of {SEVERITIES}")
    return tier


def severity(score: Column, is_alert: Column) -> Column:
    """Tier of an alert; null for non-alerts and unscored rows."""
    score = finite(score)
    tier = F.lit("low")
    for name in SEVERITIES[1:]:
        tier = F.when(score >= F.lit(TIER_FLOORS[name]), F.lit(name)).otherwise(tier)
    return F.when(is_alert & score.isNotNull(), tier)


def score_range(tier: str) -> tuple[float, float | None]:
    """Lower-inclusive, upper-exclusive score range; the top tier has no upper end."""
    order = SEVERITIES.index(check_severity(tier))
    upper = SEVERITIES[order + 1] if order + 1 < len(SEVERITIES) else None
    return TIER_FLOORS[tier], TIER_FLOORS[upper] if upper else None


def in_tier(tier: str, score: Column, is_alert: Column) -> Column:
    """Range predicate for a tier, which Parquet statistics can serve."""
    lower, upper = score_range(tier)
    inside = is_alert & (score >= F.lit(lower))
    if upper is not None:
        return inside & (score < F.lit(upper))
    # NaN would compare above every floor; it belongs to no tier.
    return inside & (score < F.lit(float("inf")))


def severity_weight(tier: Column) -> Column:
    weight = F.lit(SEVERITY_WEIGHTS["none"])
    for name in SEVERITIES:
        weight = F.when(tier == name, F.lit(SEVERITY_WEIGHTS[name])).otherwise(weight)
    return weight


def threat_label(index: Column) -> Column:
    label = F.lit("LOW")
    for name, floor in sorted(THREAT_LABELS.items(), key=lambda item: item[1])[1:]:
        label = F.when(index >= floor, F.lit(name)).otherwise(label)
    return label


def recommended_action(tier: Column) -> Column:
    action = F.lit(DEFAULT_ACTION)
    for name, text in RECOMMENDED_ACTIONS.items():
        action = F.when(tier == name, F.lit(text)).otherwise(action)
    return action


def technique(event_type: Column) -> Column:
    """Technique of an attack label: a seven-entry literal lookup, no join."""
    entries = [F.lit(part) for pair in TECHNIQUES.items() for part in pair]
    return F.create_map(*entries)[F.lower(event_type)]


def _signed(deviation: Column) -> Column:
    digits = F.regexp_replace(deviation.cast("decimal(38,2)").cast("string"), r"\.?0+$", "")
    return F.concat(F.when(deviation >= 0, F.lit("+")).otherwise(F.lit("")), digits)


def narrative(
    score: Column, is_alert: Column, top_features: Column, event_type: Column, tier: Column
) -> Column:
    """Plain-text explanation of one scored log."""
    shown_score = F.format_string("%.3f", F.coalesce(score, F.lit(0.0)))
    named = F.transform(
        F.slice(top_features, 1, 2),
        lambda f: F.concat(f["feature"], F.lit(" ("), _signed(f["deviation"]), F.lit("σ)")),
    )
    deviations = F.coalesce(
        F.nullif(F.array_join(named, " and "), F.lit("")), F.lit(NARRATIVE_NO_FEATURES)
    )
    kind = F.coalesce(F.nullif(event_type, F.lit("")), F.lit("anomaly"))
    return F.when(
        is_alert,
        F.format_string(
            NARRATIVE_ALERT, shown_score, deviations, kind, F.coalesce(tier, F.lit("null"))
        ),
    ).otherwise(F.format_string(NARRATIVE_NORMAL, shown_score))
