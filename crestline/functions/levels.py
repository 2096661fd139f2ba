"""Levels in dB, the dynamic range itself, peak rules, rounding risk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline.constants import CLIPPED, CLOSE_PEAKS, HIGH_RISK, MEDIUM_RISK, SILENT

#: A rule that picks a peak from the primary and the secondary one; any such function may be passed.
PeakRule = Callable[[Column, Column], Column]


def linear_to_db(x: Column) -> Column:
    """20 log10 x; minus infinity where x is not positive."""
    return F.when(x > 0, 20 * F.log10(x)).otherwise(F.lit(float("-inf")))


def linear_to_db_text(x: Column) -> Column:
    return F.when(x > 0, F.format_string("%.2f", 20 * F.log10(x))).otherwise(F.lit("-1.#J"))


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def dynamic_range(rms: Column, peak: Column, floor: float = 0.0) -> Column:
    """-20 log10(rms / peak), 0 unless both are above the floor; negative where the level exceeds the peak."""
    return F.when((rms > floor) & (peak > floor), -20 * F.log10(rms / peak)).otherwise(F.lit(0.0))


def rounded(x: Column) -> Column:
    """Half away from zero."""
    return F.round(x).cast("int")


def clipped(peak: Column) -> Column:
    return peak >= CLIPPED


def prefer_secondary(primary: Column, secondary: Column) -> Column:
    return F.when(secondary > 0, secondary).otherwise(primary)


def clipping_aware(primary: Column, secondary: Column) -> Column:
    """The secondary peak where the primary is clipped and there is one, else the primary."""
    return F.when(clipped(primary) & (secondary > 0), secondary).otherwise(primary)


def always_primary(primary: Column, secondary: Column) -> Column:
    return primary


PEAK_RULES: dict[str, PeakRule] = {
    "PreferSecondary": prefer_secondary,
    "ClippingAware": clipping_aware,
    "AlwaysPrimary": always_primary,
    "AlwaysSecondary": prefer_secondary,
}


def peak_ratio(primary: Column, secondary: Column) -> Column:
    return F.when(primary > 0, secondary / primary).otherwise(F.lit(0.0))


def suggested_rule(primary: Column, secondary: Column) -> Column:
    return (
        F.when(clipped(primary), F.lit("ClippingAware"))
        .when(peak_ratio(primary, secondary) > CLOSE_PEAKS, F.lit("PreferSecondary"))
        .otherwise(F.lit("AlwaysPrimary"))
    )


def silent(rms: Column, peak: Column, floor: float = SILENT) -> Column:
    return (peak <= floor) | (rms <= floor)


def boundary_risk(official: Column, precise: Column) -> Column:
    """struct(risk_level, direction, distance_db): how near the precise value is to the next rounding boundary; null if it
    is not near one. Of two candidates the higher risk counts, then the smaller distance, then the upper boundary."""

    def candidate(distance: Column, direction: str, order: int) -> Column:
        level = F.when(distance < 0, None).when(distance <= HIGH_RISK, 2).when(distance <= MEDIUM_RISK, 1)
        ranked = F.struct((-level).alias("key"), distance.alias("distance_db"), F.lit(order).alias("order"), F.lit(direction).alias("direction"))
        return F.when(level.isNotNull(), ranked)

    best = F.least(candidate(official + 0.5 - precise, "Upper", 0), candidate(precise - (official - 0.5), "Lower", 1))
    level = F.when(best["key"] == -2, "High").otherwise("Medium")
    return F.when(best.isNotNull(), F.struct(level.alias("risk_level"), best["direction"].alias("direction"), best["distance_db"].alias("distance_db")))


def potential_official(official: Column, direction: Column) -> Column:
    """The value that rounding the other way would give."""
    return F.when(direction == "Upper", official + 1).when(direction == "Lower", F.greatest(official - 1, F.lit(0)))


def boundary_warning(official: Column, precise: Column) -> Column:
    """One line for a report, null without risk."""
    risk = boundary_risk(official, precise)
    return F.when(
        risk.isNotNull(),
        F.format_string(
            "%s risk: %.2f dB lies %.2f dB from a boundary, may round to DR%d instead of DR%d",
            risk["risk_level"], precise, risk["distance_db"], potential_official(official, risk["direction"]), official,
        ),
    )


def square_sum(samples: Column) -> Column:
    """Sum of squares of an array of samples, accumulated in double precision."""
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
