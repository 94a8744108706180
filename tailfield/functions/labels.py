"""Domain, extreme, distance and zone labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailfield.constants import BOUNDARY_KM, EXTREME, IMPACT_KM
from tailfield.functions.numeric import col, pick


def domain_code(code) -> Column:
    code = col(code)
    return F.when(code == 1, "pf").when(code == 0, "npf").otherwise("other")


def subsidence(c="d_u", inclusive: bool = False) -> Column:
    c = col(c)
    return c <= 0.0 if inclusive else c < 0.0


def _threshold(target: str, domain, thresholds=EXTREME) -> Column:
    return pick(domain, {d: v for (d, t), v in thresholds.items() if t == target})


def extreme_label(target: str, value=None, domain="domain", thresholds=EXTREME) -> Column:
    """1 strictly beyond the domain's threshold, 0 otherwise, NULL without a value or threshold."""
    value = col(value if value is not None else target)
    limit = _threshold(target, domain, thresholds)
    beyond = value < limit if target == "d_u" else value > limit
    return beyond.cast("int")


def extreme_flag(target: str, value=None, domain="domain", thresholds=EXTREME) -> Column:
    """True at or beyond the domain's threshold, false otherwise, also for missing values."""
    value = col(value if value is not None else target)
    limit = _threshold(target, domain, thresholds)
    beyond = value <= limit if target == "d_u" else value >= limit
    return F.coalesce(beyond, F.lit(False))


def signed_distance(distance, domain="domain") -> Column:
    distance = col(distance)
    return F.when(col(domain) == "npf", -distance).otherwise(distance)


def process_zone(
    target: str,
    *,
    domain="domain",
    boundary="boundary_distance_km",
    feature="tlrts_distance_km",
    boundary_km: float | None = None,
    impact_km: float | None = None,
) -> Column:
    """Zone from domain, boundary distance and feature distance; ``other`` when undefined.

    The two overrides replace every boundary and every impact threshold of the target.
    """
    def boundary_limit(d):
        return BOUNDARY_KM[(target, d)] if boundary_km is None else float(boundary_km)

    def impact_limit(c):
        return IMPACT_KM[(target, c)] if impact_km is None else float(impact_km)

    domain, boundary, feature = F.lower(col(domain)), col(boundary), col(feature)
    near_npf, near_pf = boundary < boundary_limit("npf"), boundary < boundary_limit("pf")
    impact = F.when(near_pf, impact_limit("pf_transition")).otherwise(impact_limit("pf_interior"))
    pf_side = F.when(near_pf, "pf_transition").otherwise("pf_interior")
    pf_kind = F.when(feature < impact, "_impacted").otherwise("_background")
    return (
        F.when(boundary.isNull() | (boundary < 0), "other")
        .when(domain == "npf", F.when(near_npf, "npf_transition").otherwise("npf_interior"))
        .when((domain == "pf") & (feature >= 0), F.concat(pf_side, pf_kind))
        .otherwise("other")
    )


def extreme_population(
    boundary, lake_influence, slump_influence, migration_km: float = 5.0, influence: float = 0.05
) -> Column:
    boundary = col(boundary)
    attributed = (F.coalesce(col(lake_influence), F.lit(0.0)) >= influence) | (
        F.coalesce(col(slump_influence), F.lit(0.0)) >= influence
    )
    return (
        F.when(boundary.isNull(), "unclassified")
        .when(boundary < migration_km, "boundary_migration")
        .when(attributed, "interior_attributed")
        .otherwise("interior_unexplained")
    )


def source_map_domain(code) -> Column:
    """Map code to a domain after rounding half to even: 1 is pf, other non-negative codes npf."""
    rounded = F.rint(col(code))
    return F.when(rounded == 1, "pf").when(rounded >= 0, "npf").otherwise("unknown")


def feature_origin(name) -> Column:
    name = col(name)
    return F.when(name.endswith("__lstd") | name.endswith("__gmag"), "contrast").otherwise("raw")
