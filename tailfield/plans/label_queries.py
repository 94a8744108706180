"""Queries over projections, filters, predicates and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailfield.constants import EXTREME
from tailfield.functions import labels, numeric, text
from tailfield.operators import relational as rel
from tailfield.plans.inputs import basin_pixels, pixel_text, pixels, table
from tailfield.plans.registry import query, rounded


@query("p01_numeric_coercion", """SELECT pixel_id, CASE WHEN isfinite(v) THEN v END AS d_u FROM (
 SELECT pixel_id, TRY_CAST(d_u_text AS DOUBLE) AS v FROM pixel_text)""")
def p01(spark, sf):
    return pixel_text(spark, sf).select("pixel_id", numeric.coerce("d_u_text").alias("d_u"))


@query("p02_domain_code", 'SELECT "Perma_Distr_map", domain, count(*) AS n FROM pixels GROUP BY ALL')
def p02(spark, sf):
    df = pixels(spark, sf).select("Perma_Distr_map", labels.domain_code("Perma_Distr_map").alias("domain"))
    return df.groupBy("Perma_Distr_map", "domain").agg(F.count("*").alias("n"))


@query("p03_unit_fallback", """SELECT pixel_id, round(coalesce(CASE WHEN slope > 4 THEN grad_mag_km END,
 grad_mag * 1000), 6) AS grad_mag_km FROM pixels""")
def p03(spark, sf):
    per_km = F.when(F.col("slope") > 4, F.col("grad_mag_km"))
    return rounded(pixels(spark, sf).select("pixel_id", numeric.unit_fallback(per_km, "grad_mag").alias("grad_mag_km")))


@query("p04_derived_columns", """SELECT pixel_id, abs(d_u) AS abs_du, CASE WHEN grad_mag IS NOT NULL
 THEN round(ln(1 + greatest(grad_mag, 0)), 8) END AS log_grad_mag FROM pixels""")
def p04(spark, sf):
    return rounded(pixels(spark, sf).select("pixel_id", F.abs("d_u").alias("abs_du"),
                                            numeric.log1p_clipped("grad_mag").alias("log_grad_mag")), 8)


@query("p05_missing_category", """SELECT coalesce("Main-Basin", 'missing') AS basin, count(*) AS n
 FROM basin_pixels GROUP BY 1""")
def p05(spark, sf):
    df = basin_pixels(spark, sf).withColumn("basin", F.coalesce("Main-Basin", F.lit("missing")))
    return df.groupBy("basin").agg(F.count("*").alias("n"))


@query("p06_finite_rows", """SELECT domain, count(*) AS n, round(sum(magt + vwc35), 6) AS total FROM pixels
 WHERE magt IS NOT NULL AND vwc35 IS NOT NULL AND grad_mag IS NOT NULL GROUP BY domain""")
def p06(spark, sf):
    return rounded(rel.drop_missing(pixels(spark, sf), ["magt", "vwc35", "grad_mag"]).groupBy("domain").agg(
        F.count("*").alias("n"), F.sum(F.col("magt") + F.col("vwc35")).alias("total")))


@query("p07_subsidence_filters", """SELECT domain, count(*) FILTER (d_u < 0) AS n_strict,
 count(*) FILTER (d_u <= 0) AS n_inclusive FROM pixels GROUP BY domain""")
def p07(spark, sf):
    return pixels(spark, sf).groupBy("domain").agg(
        F.count_if(labels.subsidence()).alias("n_strict"),
        F.count_if(labels.subsidence(inclusive=True)).alias("n_inclusive"))


_THR = ", ".join(f"('{t}', '{d}', {v}::DOUBLE)" for (d, t), v in EXTREME.items())


@query("p08_strict_label", f"""WITH thr(target, domain, threshold) AS (VALUES {_THR}),
 long AS (SELECT 'd_u' AS target, domain, d_u AS value FROM pixels
 UNION ALL SELECT 'grad_mag_km', domain, grad_mag_km FROM pixels),
 lab AS (SELECT target, domain, CASE WHEN value IS NULL OR threshold IS NULL THEN NULL WHEN target = 'd_u'
 THEN CAST(value < threshold AS INTEGER) ELSE CAST(value > threshold AS INTEGER) END AS label
 FROM long LEFT JOIN thr USING (target, domain))
 SELECT target, domain, label, count(*) AS n FROM lab GROUP BY ALL""")
def p08(spark, sf):
    long = pixels(spark, sf).unpivot(["domain"], ["d_u", "grad_mag_km"], "target", "value")
    joined = long.join(F.broadcast(rel.threshold_table(spark)), ["target", "domain"], "left")
    beyond = F.when(F.col("target") == "d_u", F.col("value") < F.col("threshold")).otherwise(
        F.col("value") > F.col("threshold"))
    return joined.withColumn("label", beyond.cast("int")).groupBy("target", "domain", "label").agg(
        F.count("*").alias("n"))


@query("p09_inclusive_flag", """SELECT domain, count(*) FILTER ((domain = 'pf' AND d_u <= -16.5)
 OR (domain = 'npf' AND d_u <= -7.4)) AS n_du, count(*) FILTER ((domain = 'pf' AND grad_mag_km >= 30.5)
 OR (domain = 'npf' AND grad_mag_km >= 17.0)) AS n_grad, count(*) AS n FROM pixels GROUP BY domain""")
def p09(spark, sf):
    return pixels(spark, sf).groupBy("domain").agg(
        F.count_if(labels.extreme_flag("d_u")).alias("n_du"),
        F.count_if(labels.extreme_flag("grad_mag_km")).alias("n_grad"), F.count("*").alias("n"))


@query("p10_pooled_tail_label", """SELECT domain, CAST(d_u <= (SELECT quantile_cont(d_u, 0.05) FROM pixels) AS INTEGER)
 AS du_tail, CAST(grad_mag_km >= (SELECT quantile_cont(grad_mag_km, 0.95) FROM pixels) AS INTEGER) AS grad_tail,
 count(*) AS n FROM pixels GROUP BY ALL""")
def p10(spark, sf):
    df = rel.pooled_tail_label(rel.pooled_tail_label(pixels(spark, sf), "d_u", "du_tail"), "grad_mag_km", "grad_tail")
    return df.groupBy("domain", "du_tail", "grad_tail").agg(F.count("*").alias("n"))


@query("p11_signed_distance", """SELECT pixel_id, CASE WHEN domain = 'npf' AND boundary_distance_km <> 0
 THEN -boundary_distance_km ELSE boundary_distance_km END AS signed_km FROM pixels""")
def p11(spark, sf):
    return rounded(pixels(spark, sf).select("pixel_id", labels.signed_distance("boundary_distance_km").alias("signed_km")))


def zone_sql(target="d_u", b_npf=3.25, b_pf=3.25, i_tr=4.25, i_in=2.75):
    b, f = "boundary_distance_km", "tlrts_distance_km"
    return (f"CASE WHEN {b} IS NULL THEN 'other' WHEN domain = 'npf' AND {b} < {b_npf} THEN 'npf_transition'"
            f" WHEN domain = 'npf' THEN 'npf_interior' WHEN domain <> 'pf' OR {f} IS NULL THEN 'other'"
            f" WHEN {b} < {b_pf} AND {f} < {i_tr} THEN 'pf_transition_impacted'"
            f" WHEN {b} < {b_pf} THEN 'pf_transition_background'"
            f" WHEN {f} < {i_in} THEN 'pf_interior_impacted' ELSE 'pf_interior_background' END")


@query("p12_process_zone", f"""SELECT {zone_sql()} AS du_zone, {zone_sql('g', 4.25, 1.75, 5.25, 9.25)} AS grad_zone,
 {zone_sql('d_u', 5.0, 5.0, 2.0, 2.0)} AS fixed_zone, count(*) AS n FROM pixels GROUP BY ALL""")
def p12(spark, sf):
    df = pixels(spark, sf).select(
        labels.process_zone("d_u").alias("du_zone"), labels.process_zone("grad_mag_km").alias("grad_zone"),
        labels.process_zone("d_u", boundary_km=5.0, impact_km=2.0).alias("fixed_zone"))
    return df.groupBy("du_zone", "grad_zone", "fixed_zone").agg(F.count("*").alias("n"))


@query("p13_extreme_population", """SELECT CASE WHEN boundary_distance_km IS NULL THEN 'unclassified'
 WHEN boundary_distance_km < 5 THEN 'boundary_migration'
 WHEN coalesce(vwc35, 0) / 5 >= 0.05 OR coalesce(ndvi, 0) / 10 >= 0.05 THEN 'interior_attributed'
 ELSE 'interior_unexplained' END AS population, count(*) AS n FROM pixels WHERE domain = 'pf' GROUP BY 1""")
def p13(spark, sf):
    kind = labels.extreme_population("boundary_distance_km", F.col("vwc35") / 5, F.col("ndvi") / 10)
    return pixels(spark, sf).where("domain = 'pf'").groupBy(kind.alias("population")).agg(F.count("*").alias("n"))


@query("p14_source_map_domain", """SELECT CASE WHEN round_even(magt, 0) = 1 THEN 'pf'
 WHEN round_even(magt, 0) >= 0 THEN 'npf' ELSE 'unknown' END AS map_domain, count(*) AS n FROM pixels GROUP BY 1""")
def p14(spark, sf):
    return pixels(spark, sf).groupBy(labels.source_map_domain("magt").alias("map_domain")).agg(F.count("*").alias("n"))


SCALES = {"dem": (-32.0, 5.0 / 9.0), "slope": (0.0, 0.1), "ndvi": (0.0, 1000.0)}


@query("p15_unit_transforms", """SELECT variable, count(*) AS n, round(sum(v), 4) AS total,
 round(min(degrees(r)), 6) AS min_deg FROM (SELECT 'dem' AS variable, (dem - 32) * (5.0::DOUBLE / 9.0::DOUBLE) AS v,
 slope AS r FROM pixels UNION ALL SELECT 'slope', slope * 0.1::DOUBLE, slope FROM pixels
 UNION ALL SELECT 'ndvi', ndvi * 1000, slope FROM pixels UNION ALL SELECT 'soc', soc, slope FROM pixels) GROUP BY variable""")
def p15(spark, sf):
    long = pixels(spark, sf).select(F.col("slope").alias("r"), "dem", "slope", "ndvi", "soc").unpivot(
        ["r"], ["dem", "slope", "ndvi", "soc"], "variable", "value")
    return rounded(long.groupBy("variable").agg(
        F.count("*").alias("n"), F.sum(numeric.linear_transform("variable", "value", SCALES)).alias("total"),
        F.min(F.degrees("r")).alias("min_deg")), 6, total=4)


@query("p16_zero_as_nodata", """SELECT domain, count(CASE WHEN abs(d_u) > 1e-8 THEN d_u END) AS n_valid,
 round(avg(CASE WHEN abs(d_u) > 1e-8 THEN d_u END), 6) AS mean_valid FROM pixels GROUP BY domain""")
def p16(spark, sf):
    v = numeric.zero_as_missing("d_u")
    return rounded(pixels(spark, sf).groupBy("domain").agg(F.count(v).alias("n_valid"), F.avg(v).alias("mean_valid")))


_FAMILY = "('magt','thermal'),('slope','terrain_energy'),('dem','terrain_energy'),('soc','soil_substrate'),('ndvi','vegetation_productivity'),('slope__lstd','terrain_energy')"


@query("p17_feature_families", f"""WITH fam(feature, family) AS (VALUES {_FAMILY}), long AS (
 SELECT 'magt' AS feature, count(magt) AS n FROM pixels UNION ALL SELECT 'slope', count(slope) FROM pixels
 UNION ALL SELECT 'dem', count(dem) FROM pixels UNION ALL SELECT 'soc', count(soc) FROM pixels
 UNION ALL SELECT 'ndvi', count(ndvi) FROM pixels UNION ALL SELECT 'slope__lstd', count(slope) FROM pixels)
 SELECT feature, family, CASE WHEN feature LIKE '%lstd' THEN 'contrast' ELSE 'raw' END AS origin, n
 FROM long JOIN fam USING (feature)""")
def p17(spark, sf):
    names = ["magt", "slope", "dem", "soc", "ndvi", "slope__lstd"]
    counts = pixels(spark, sf).withColumn("slope__lstd", F.col("slope")).agg(*[F.count(c).alias(c) for c in names])
    long = counts.unpivot([], names, "feature", "n")
    return rel.assign_families(long, spark).select("feature", "family", "origin", "n")


@query("p18_boolean_text", """SELECT flag_text, coalesce(lower(trim(flag_text)) IN ('1','true','t','yes','y'), false) AS flag,
 count(*) AS n FROM pixel_text GROUP BY ALL""")
def p18(spark, sf):
    df = pixel_text(spark, sf).select("flag_text", text.truthy("flag_text").alias("flag"))
    return df.groupBy("flag_text", "flag").agg(F.count("*").alias("n"))


@query("p19_site_label", """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Site ' || c_custkey
 ELSE trim(c_mktsegment) END AS label FROM customer""")
def p19(spark, sf):
    sites = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, "  nan ").otherwise("").alias("english_st"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "None").otherwise(F.col("c_mktsegment")).alias("station_name"))
    out = text.site_label(sites, ["english_st", "english_station_name", "station_name"], "c_custkey")
    return out.select("c_custkey", F.coalesce("label", F.concat(F.lit("Site "), F.col("c_custkey"))).alias("label"))


@query("p20_date_token", """SELECT coalesce(nullif(regexp_extract(name, '(^|[^0-9])((19|20)[0-9]{6})($|[^0-9])', 2), ''), '')
 AS token, count(*) AS n FROM (SELECT 'tile_' || CASE WHEN l_linenumber = 1 THEN '9' ELSE '' END
 || strftime(l_shipdate, '%Y%m%d') || '.pkg' AS name FROM lineitem) GROUP BY 1""")
def p20(spark, sf):
    name = F.concat(F.lit("tile_"), F.when(F.col("l_linenumber") == 1, "9").otherwise(""),
                    F.date_format("l_shipdate", "yyyyMMdd"), F.lit(".pkg"))
    return table(spark, sf, "lineitem").groupBy(text.date_token(name).alias("token")).agg(F.count("*").alias("n"))


@query("p21_label_formatting", """SELECT b AS bin, CASE WHEN b = 5 THEN '>25' ELSE (b*5)::VARCHAR || '–' || (b*5+5)::VARCHAR END
 AS bin_label, CASE WHEN b = 0 THEN 'All NPF' ELSE '≥ ' || (b*5)::VARCHAR || ' km' END || ' (' ||
 CAST(round_even(n * 100.0::DOUBLE / total, 0) AS INTEGER)::VARCHAR || '%)' AS retained,
 '$' || CAST(80 + b AS VARCHAR) || CASE WHEN b % 2 = 1 THEN '.5' ELSE '' END || '^\\circ$ E' AS lon_label,
 CASE WHEN b = 0 THEN '<1e-3' ELSE printf('%.3f', b / 16.0::DOUBLE) END AS p_text, n FROM (
 SELECT CAST(least(floor(l_quantity / 10), 5) AS BIGINT) AS b, count(*) AS n, sum(count(*)) OVER () AS total FROM lineitem GROUP BY 1)""")
def p21(spark, sf):
    bins = table(spark, sf, "lineitem").groupBy(
        F.least(F.floor(F.col("l_quantity") / 10), F.lit(5)).alias("bin")).agg(F.count("*").alias("n"))
    total = table(spark, sf, "lineitem").agg(F.count("*")).scalar()
    lo = (F.col("bin") * 5).cast("double")
    hi = F.when(F.col("bin") < 5, lo + 5)
    lon = F.lit(80.0) + F.col("bin") + F.when(F.col("bin") % 2 == 1, 0.5).otherwise(0.0)
    return bins.select(
        "bin", text.distance_bin_label(lo, hi).alias("bin_label"),
        text.retained_label(lo, F.col("n") / total).alias("retained"),
        text.degree_label(lon, "E", "W").alias("lon_label"), text.p_value_text(F.col("bin") / 16).alias("p_text"), "n")


@query("p22_key_map", f"""SELECT CASE {zone_sql()} WHEN 'pf_transition_impacted' THEN 'pf_transition_thermokarst_feature_impacted'
 WHEN 'pf_interior_impacted' THEN 'pf_interior_thermokarst_feature_impacted' ELSE {zone_sql()} END AS neighborhood_key,
 count(*) AS n FROM pixels GROUP BY 1""")
def p22(spark, sf):
    zones = pixels(spark, sf).groupBy(labels.process_zone("d_u").alias("zone")).agg(F.count("*").alias("n"))
    return rel.rename_zones(zones).withColumnsRenamed({"zone": "neighborhood_key"})


@query("p23_box_filter", """SELECT domain, count(*) AS n FROM pixels WHERE easting BETWEEN -1900000 AND -1887952
 AND northing BETWEEN 4136440 AND 4150000 GROUP BY domain""")
def p23(spark, sf):
    df = pixels(spark, sf).where(rel.in_box("easting", "northing", -1900000, 4136440, -1887952, 4150000))
    return df.groupBy("domain").agg(F.count("*").alias("n"))


ANALYSIS_ZONE_SQL = """CASE WHEN domain <> 'pf' THEN domain WHEN boundary_distance_km < 5 AND tlrts_distance_km < 2
 THEN 'pf_overlap' WHEN boundary_distance_km < 5 THEN 'pf_frontal_iso' WHEN tlrts_distance_km < 2
 THEN 'pf_abrupt_iso' ELSE 'pf_background' END"""


@query("p24_candidate_subset", f"""WITH z AS (SELECT *, {ANALYSIS_ZONE_SQL} AS analysis_zone FROM pixels)
 SELECT analysis_zone, count(*) FILTER (analysis_zone = 'pf_frontal_iso') AS transition,
 count(*) FILTER (analysis_zone IN ('pf_abrupt_iso', 'pf_overlap') AND tl_distance_km <= rts_distance_km) AS near_tl,
 count(*) FILTER (analysis_zone IN ('pf_abrupt_iso', 'pf_overlap') AND rts_distance_km < tl_distance_km) AS near_rts,
 count(*) FILTER (analysis_zone = 'pf_background') AS interior FROM z GROUP BY analysis_zone""")
def p24(spark, sf):
    df = pixels(spark, sf).withColumn("analysis_zone", rel.analysis_zone())
    return df.groupBy("analysis_zone").agg(
        *[F.count_if(rel.candidate_filter(k)).alias(k) for k in rel.CANDIDATE_ZONES])
