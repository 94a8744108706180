"""Text parsing and label formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailfield.functions.numeric import col

# Text that counts as true.
TRUE_WORDS = ("1", "true", "t", "yes", "y")


def truthy(c) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def usable_label(c) -> Column:
    """Trimmed text, NULL when blank or a written-out missing value."""
    text = F.trim(col(c).cast("string"))
    return F.when((text != "") & ~F.lower(text).isin("nan", "none"), text)


def site_label(df: DataFrame, candidates: list[str], id_col: str, out: str = "label") -> DataFrame:
    """Label from the first candidate column that has any usable text, else ``Site <id>``.

    The choice of column is one aggregate over the table, used as a scalar
    subquery, so that the rows are labelled without a join.
    """
    present = [c for c in candidates if c in df.columns]
    if not present:
        return df.withColumn(out, F.format_string("Site %s", col(id_col).cast("string")))
    flags = [F.max(usable_label(c).isNotNull()).alias(f"f{i}") for i, c in enumerate(present)]
    first = F.coalesce(*[F.when(F.col(f"f{i}"), i) for i in range(len(present))], F.lit(-1))
    chosen = df.agg(*flags).select(first.alias("chosen")).scalar()
    label = None
    for i, c in enumerate(present):
        label = F.when(F.col("_chosen") == i, usable_label(c)) if label is None else label.when(
            F.col("_chosen") == i, usable_label(c))
    label = label.otherwise(F.format_string("Site %s", col(id_col).cast("string")))
    return df.withColumn("_chosen", chosen).withColumn(out, label).drop("_chosen")


def date_token(c) -> Column:
    """Eight digits starting 19 or 20 that are not part of a longer number; else empty."""
    return F.regexp_extract(col(c), r"(?<!\d)((?:19|20)\d{6})(?!\d)", 1)


def short_number(c) -> Column:
    """A number without trailing zeros, six significant decimals at most."""
    text = F.format_string("%.6f", col(c).cast("double"))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def distance_bin_label(lo, hi) -> Column:
    hi = col(hi)
    open_end = hi.isNull() | (hi == F.lit(float("inf")))
    return F.when(open_end, F.concat(F.lit(">"), short_number(lo))).otherwise(
        F.concat(short_number(lo), F.lit("–"), short_number(hi))
    )


def retained_label(buffer_km, fraction) -> Column:
    buffer_km, fraction = col(buffer_km), col(fraction)
    base = F.when(F.abs(buffer_km) <= 1e-8, "All NPF").otherwise(
        F.concat(F.lit("≥ "), short_number(buffer_km), F.lit(" km"))
    )
    share = F.concat(base, F.lit(" ("), F.rint(fraction * 100.0).cast("int").cast("string"), F.lit("%)"))
    return F.coalesce(share, base)


def degree_label(c, positive: str, negative: str) -> Column:
    """Absolute degrees with at most one decimal and a hemisphere letter; empty when missing."""
    c = col(c)
    size = F.abs(c)
    whole = F.abs(size - F.rint(size)) <= 1e-6 + 1e-5 * F.rint(size)
    number = F.when(whole, F.rint(size).cast("int").cast("string")).otherwise(
        F.regexp_replace(F.format_number(size, 1), r"\.0$", "")
    )
    letter = F.when(c >= 0, positive).otherwise(negative)
    return F.coalesce(F.concat(F.lit("$"), number, F.lit(r"^\circ$ "), letter), F.lit(""))


def p_value_text(p) -> Column:
    p = col(p)
    return F.when(p.isNull(), "NA").when(p < 1e-3, "<1e-3").otherwise(F.format_number(p, 3))
