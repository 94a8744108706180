"""Thresholds, feature lists, zone names and grid parameters."""

from __future__ import annotations

from pyspark.sql import types as T

TARGETS = ("d_u", "grad_mag_km")
DOMAINS = ("pf", "npf")

# Extreme thresholds per (domain, target).
EXTREME = {
    ("pf", "d_u"): -16.5,
    ("npf", "d_u"): -7.4,
    ("pf", "grad_mag_km"): 30.5,
    ("npf", "grad_mag_km"): 17.0,
}

# Boundary transition distance in km per (target, domain).
BOUNDARY_KM = {
    ("d_u", "npf"): 3.25,
    ("d_u", "pf"): 3.25,
    ("grad_mag_km", "npf"): 4.25,
    ("grad_mag_km", "pf"): 1.75,
}

# Feature impact distance in km per (target, boundary class).
IMPACT_KM = {
    ("d_u", "pf_all"): 3.25,
    ("d_u", "pf_transition"): 4.25,
    ("d_u", "pf_interior"): 2.75,
    ("grad_mag_km", "pf_all"): 8.75,
    ("grad_mag_km", "pf_transition"): 5.25,
    ("grad_mag_km", "pf_interior"): 9.25,
}

# Zone keys in report order, with domain and export key.
ZONES = (
    ("npf_transition", "npf", "NPF transition", "npf_transition"),
    ("npf_interior", "npf", "NPF interior", "npf_interior"),
    ("pf_transition_impacted", "pf", "PF transition + thermokarst-feature impacted",
     "pf_transition_thermokarst_feature_impacted"),
    ("pf_transition_background", "pf", "PF transition background", "pf_transition_background"),
    ("pf_interior_impacted", "pf", "PF interior + thermokarst-feature impacted",
     "pf_interior_thermokarst_feature_impacted"),
    ("pf_interior_background", "pf", "PF interior background", "pf_interior_background"),
)

# Predictors of the per-cell table.
RAW_FEATURES = (
    "magt", "precipitation_mean", "temperature_mean", "bulk_density", "cf", "soc",
    "soil_thickness", "dem", "difpr", "dirpr", "slope", "twi", "gpp_mean", "ndvi",
)

# Base variables with local-contrast predictors, per predictor family.
CONTRAST_BASE = ("magt", "twi", "ndvi", "bulk_density", "cf", "soc", "soil_thickness", "dem", "slope")
FAMILIES = {
    "thermal": ("Thermal", ("magt", "temperature_mean")),
    "hydro_wetness": ("Hydro-wetness", ("precipitation_mean", "twi")),
    "vegetation_productivity": ("Vegetation/productivity", ("ndvi", "gpp_mean")),
    "soil_substrate": ("Soil/substrate", ("bulk_density", "cf", "soc", "soil_thickness")),
    "terrain_energy": ("Terrain/energy", ("dem", "slope", "difpr", "dirpr")),
}


def family_members() -> list[tuple[str, str, str]]:
    """(feature, family, label) rows: raw features plus the contrast features of base variables."""
    rows = []
    for family, (label, raw) in FAMILIES.items():
        for name in raw:
            rows.append((name, family, label))
            if name in CONTRAST_BASE:
                rows += [(f"{name}__{suffix}", family, label) for suffix in ("lstd", "gmag")]
    return rows


# The projected grid and its Albers equal-area projection.
GRID = {"res": 136.0, "gx0": -14007, "gy1": 30570}
ALBERS = {"a": 6378245.0, "inv_f": 298.3, "lon0": 110.0, "lat0": 0.0, "lat1": 25.0, "lat2": 47.0}
EARTH_RADIUS_KM = 6371.0

PIXEL_SCHEMA = T.StructType(
    [T.StructField("pixel_id", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in
       ("easting", "northing", "longitude", "latitude", "d_u", "dudx", "dudy", "grad_mag", "grad_mag_km")]
    + [T.StructField("Perma_Distr_map", T.IntegerType()), T.StructField("Main-Basin", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in (*RAW_FEATURES, "vwc35")]
)
