"""DataFrame -> DataFrame cleaning steps (projections only, no shuffle)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens import schemas
from incidentlens.functions.cleaning import parse_date, round_half


class NoLabelledRows(ValueError):
    """No row of the input has a known target."""


def drop_unlabelled(df: DataFrame, target: str, check: bool = False) -> DataFrame:
    """Keep rows with a known target. ``check`` looks at the data and raises when none remain."""
    kept = df.filter(F.col(target).isNotNull())
    if check and kept.isEmpty():
        raise NoLabelledRows("no usable rows remain after dropping unknown action classes")
    return kept


def fill_unknown(df: DataFrame, cols) -> DataFrame:
    return df.withColumns(
        {c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit("Unknown")).otherwise(F.col(c)) for c in cols}
    )


def event_year_month(df: DataFrame, col: str = "date", formats=None) -> DataFrame:
    day = parse_date(F.col(col), formats)
    return df.withColumns({"event_year": F.year(day), "event_month": F.month(day)})


def feature_projection(df: DataFrame, keep=()) -> DataFrame:
    """Exactly the 13 feature columns in order (after ``keep``); absent ones become NULL."""
    def pick(c):
        if c in df.columns:
            return F.col(c)
        return F.lit(None).cast("string" if c in fv.CATEGORICAL else "double").alias(c)

    return df.select(*keep, *[pick(c) for c in fv.FEATURES])


def column_alias_fallback(df: DataFrame, aliases: dict) -> DataFrame:
    """Rename ``alias -> column`` where the column itself is absent."""
    renames = {a: c for a, c in aliases.items() if a in df.columns and c not in df.columns}
    return df.withColumnsRenamed(renames)


def with_collation(df: DataFrame, cols, collation: str = "UNICODE_CI_AI") -> DataFrame:
    """Compare, group and sort the given text columns by a collation instead of by bytes."""
    return df.withColumns({c: F.collate(c, collation) for c in cols})


DEVICE_ALIASES = {"implantation_status": "implanted"}


def risk_bands(df: DataFrame, prediction="prediction", probability="risk_score") -> DataFrame:
    p = F.col(probability)
    level = F.when((F.col(prediction) == 1) | (p >= 0.5), F.lit("HIGH")).otherwise(F.lit("LOW"))
    return df.withColumns(
        {
            "risk_percentage": round_half(p * 100, 2),
            "risk_level": level,
            "prediction_label": F.when(level == "HIGH", F.lit("High Risk")).otherwise(F.lit("Low Risk")),
        }
    )


def nested_json(df: DataFrame, encode: bool = True) -> DataFrame:
    """Encode or decode the two nested columns at the storage boundary.

    Decoding rebuilds an empty ``features_used`` from the 13 stored columns.
    """
    if encode:
        return df.withColumns({c: F.to_json(c) for c in ("risk_factors", "features_used")})
    rebuilt = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.lit(fv.PROVENANCE_LABELS[f]).alias("feature_name"),
                F.col(f).cast("string").alias("value"),
                F.lit(fv.SRC_RECORDED).alias("source"),
            )
            for f in fv.FEATURES
        ]
    )
    factors = F.from_json("risk_factors", F.lit("array<" + schemas.FACTOR.simpleString() + ">"))
    used = F.from_json("features_used", F.lit("array<" + schemas.PROVENANCE.simpleString() + ">"))
    return df.withColumns(
        {
            "risk_factors": F.coalesce(factors, F.array().cast(f"array<{schemas.FACTOR.simpleString()}>")),
            "features_used": F.when(F.size(F.coalesce(used, F.array().cast(used_type()))) > 0, used).otherwise(rebuilt),
        }
    )


def used_type() -> str:
    return f"array<{schemas.PROVENANCE.simpleString()}>"
