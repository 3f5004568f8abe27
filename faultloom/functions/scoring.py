"""Scores, labels and text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400.0


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def settle(col, digits: int) -> Column:
    """Rounded value that does not hang on the last bit of a sum: the order in
    which tasks add up must not move a value across a rounding boundary."""
    return F.round(F.round(_c(col), 9), digits)


def severity_multiplier(level) -> Column:
    """Weight of a severity level; an unknown level weighs like level 1."""
    level = F.coalesce(_c(level).cast("int"), F.lit(1))
    # fixed values: 1, 3, 7, 12
    return F.when(level <= 1, 1.0).when(level == 2, 3.0).when(level == 3, 7.0).otherwise(12.0)


def duration_factor(seconds) -> Column:
    return 1.0 + F.least(_c(seconds).cast("double") / SECONDS_PER_DAY, F.lit(30.0)) / 10.0


def recurrence_factor(episodes) -> Column:
    n = F.coalesce(_c(episodes).cast("double"), F.lit(1.0))
    return 1.0 + F.greatest(F.lit(0.0), n - 1.0) * 0.5


def health_score(risk, k: float) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - F.least(F.coalesce(_c(risk), F.lit(0.0)) * k, F.lit(100.0)))


def clean_text(col, *, none_word: bool = True) -> Column:
    """Placeholder words and nulls become the empty string."""
    c = F.nullif(_c(col), F.lit("nan"))
    if none_word:
        c = F.nullif(c, F.lit("None"))
    return F.coalesce(c, F.lit(""))


def clamp_severity(level) -> Column:
    return F.greatest(F.coalesce(_c(level).cast("int"), F.lit(1)), F.lit(1))


def issue_flags(system="system", subsystem="subsystem") -> dict[str, Column]:
    """0/1 flags per issue family from the raw dimension texts."""
    sys_, sub = F.lower(F.coalesce(_c(system), F.lit(""))), F.lower(F.coalesce(_c(subsystem), F.lit("")))
    flags = {
        "has_engine_issue": sub.contains("powertrain") | sys_.contains("engine"),
        "has_coolant_issue": sub.contains("coolant"),
        "has_safety_issue": sys_.contains("safety"),
        "has_emission_issue": sub.contains("emission") | sys_.contains("emission"),
        "has_electrical_issue": sub.contains("electrical") | sys_.contains("electrical"),
    }
    return {name: cond.cast("int") for name, cond in flags.items()}


def episode_key(uniqueid="uniqueid", code="dtc_code", number="episode_no") -> Column:
    return F.concat_ws("_", _c(uniqueid), _c(code), _c(number).cast("string"))


def event_date(epoch) -> Column:
    """UTC date of an epoch second (days since 1970, so no session zone is involved)."""
    return F.date_from_unix_date(F.floor(_c(epoch) / F.lit(86400)).cast("int"))


def fault_trend(recent, prior) -> Column:
    recent, prior = F.coalesce(_c(recent), F.lit(0)), F.coalesce(_c(prior), F.lit(0))
    return (
        F.when(recent > prior * 1.1 + 1, "increasing")
        .when((prior > 0) & (recent < prior * 0.9), "decreasing")
        .otherwise("stable")
    )


def vehicle_severity_label(level) -> Column:
    level = _c(level)
    return F.when(level >= 4, "Critical").when(level == 3, "High").when(level == 2, "Moderate").otherwise("Minor")


def maintenance_severity_label(level) -> Column:
    level = _c(level)
    return F.when(level >= 4, "Critical").when(level == 3, "High").when(level == 2, "Moderate").otherwise("Low")


def code_severity_type(level) -> Column:
    level = _c(level)
    return (
        F.when(level >= 3, "Critical").when(level == 2, "Major").when(level == 1, "Minor")
        .when(level == 0, "Info").otherwise("Unknown")
    )


def health_label(score) -> Column:
    score = _c(score)
    return F.when(score >= 95, "Excellent").when(score >= 80, "Good").when(score >= 60, "Fair").otherwise("Poor")


def unit_score(col, default: float = 0.5) -> Column:
    """A recorded score held inside 0..1, three decimals, default when unusable."""
    value = F.coalesce(_c(col).try_cast("double"), F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), settle(value, 3)))


def final_score(correctness, groundedness, relevance, completeness) -> Column:
    # fixed weights: 0.30, 0.25, 0.20, 0.25
    return settle(
        0.30 * unit_score(correctness) + 0.25 * unit_score(groundedness)
        + 0.20 * unit_score(relevance) + 0.25 * unit_score(completeness), 3,
    )


def heaviest(key: str, weight: str) -> Column:
    """Key with the largest weight among one row per key; ties go to the smallest key."""
    return F.min_by(F.col(key), F.struct(-F.col(weight), F.col(key)))


def mean_positive(total, count) -> Column:
    """Mean from a sum and a count, zero when nothing was counted."""
    return F.coalesce(F.try_divide(_c(total).cast("double"), _c(count).cast("double")), F.lit(0.0))


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def is_open() -> Column:
    return F.col("is_resolved") == 0


def is_severe() -> Column:
    return F.col("severity_level") >= 3


def has_lasted() -> Column:
    return F.col("resolution_time_sec") > 0


def by_driver() -> Column:
    return F.col("driver_related") == 1
