"""Column -> Column cleaning rules. Everything stays inside generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv


def strip(c: Column) -> Column:
    """Cut all leading and trailing whitespace (``trim`` only cuts spaces)."""
    # Trimming costs less than the pattern, whose ``$`` also stands before a last line end beyond ASCII.
    odd = c.endswith("\u0085") | c.endswith("\u2028") | c.endswith("\u2029")
    return F.when(odd, F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(F.trim(c, F.lit(" \t\n\x0b\f\r")))


def clean_text(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def blank_to_null(c: Column) -> Column:
    text = strip(c)
    return F.when(text != "", text)


def class_token(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(""))


def _target(c, low, high):
    token = class_token(c)
    return F.when(token.isin(low), F.lit(0)).when(token.isin(high), F.lit(1))


def risk_target_v1(c: Column) -> Column:
    """Class I is low risk, classes II and III are high risk, anything else unknown."""
    return _target(c, fv.TARGET_V1_LOW, fv.TARGET_V1_HIGH)


def risk_target_v2(c: Column) -> Column:
    """Classes I and II are low risk, class III and voluntary recalls high risk."""
    return _target(c, fv.TARGET_V2_LOW, fv.TARGET_V2_HIGH)


def upper_implanted(c: Column) -> Column:
    """Upper-cased implant text; missing becomes ``Unknown``, blank stays blank."""
    return F.coalesce(F.upper(strip(c)), F.lit("Unknown"))


def to_numeric(c: Column) -> Column:
    """Number or NULL; the text ``NaN`` counts as missing."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_date(c: Column, formats=None) -> Column:
    """ISO date by default; with ``formats`` the first format that parses wins."""
    if not formats:
        return c.try_cast("date")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def map_implant_status(c: Column, strict: bool = False) -> Column:
    """YES when the text contains YES or IMPLANTED, else NO.

    ``No - Non-implanted`` contains IMPLANTED and so gives YES; ``strict`` tests
    for a leading NO first.
    """
    text = F.upper(clean_text(c))
    yes = text.contains("YES") | text.contains("IMPLANTED")
    if strict:
        yes = yes & ~text.startswith("NO")
    return F.when(yes, F.lit("YES")).otherwise(F.lit("NO"))


def gauge_clamp(pct: Column) -> Column:
    """Percent clamped to 0..100; missing and NaN give 0."""
    safe = F.coalesce(F.nanvl(pct.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), safe))


def gauge_is_high(pct: Column, level: Column) -> Column:
    return F.coalesce(F.upper(level) == "HIGH", F.lit(False)) | (gauge_clamp(pct) >= 50)


def round_half(c: Column, digits: int) -> Column:
    """Round through a decimal so that equal inputs round alike in every engine."""
    return F.round(c.cast("decimal(38,8)"), digits).cast("double")
