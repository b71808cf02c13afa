"""Risk factors, narratives and maintenance texts as array and string expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.functions.cleaning import round_half


def rule_attributions(df: DataFrame) -> DataFrame:
    """``contributions``: a struct with a fixed weight per feature by simple thresholds, in rule order."""
    named = F.col("classification").contains(fv.RULE_CLASSIFICATIONS[0])
    for text in fv.RULE_CLASSIFICATIONS[1:]:
        named = named | F.col("classification").contains(text)
    tests = {
        "risk_class": F.col("risk_class").isin(fv.RULE_RISK_CLASSES),
        "event_count": F.col("event_count") > fv.RULE_EVENTS,
        "manufacturer_event_count": F.col("manufacturer_event_count") > fv.RULE_MANUFACTURER_EVENTS,
        "implanted": F.upper("implanted") == fv.RULE_IMPLANTED,
        "classification": named,
        "type": F.col("type").contains(fv.RULE_TYPE),
        "quantity_in_commerce": F.col("quantity_in_commerce") > fv.RULE_QUANTITY,
    }

    def weight(f):
        yes, no = fv.RULE_WEIGHTS[f]
        return F.when(F.coalesce(tests.get(f, F.lit(False)), F.lit(False)), F.lit(yes)).otherwise(F.lit(no)).cast("double")

    return df.withColumn("contributions", F.struct(*[weight(f).alias(f) for f in fv.RULE_ORDER]))


def contribution_rows(df: DataFrame, *keep) -> DataFrame:
    """``contributions`` as one row per feature."""
    order = df.schema["contributions"].dataType.fieldNames()
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"contributions.{f}").alias("impact")) for f in order])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*")


def impact_band(c: Column) -> Column:
    return (
        F.when(c > fv.IMPACT_THRESHOLD, fv.ELEVATED)
        .when(c < -fv.IMPACT_THRESHOLD, fv.REDUCED)
        .otherwise(fv.NEUTRAL)
    )


def _pick(names: dict, key: Column, other: Column) -> Column:
    out = other
    for name, text in names.items():
        out = F.when(key == name, F.lit(text)).otherwise(out)
    return out


def factor_description(f: Column, v: Column, band: Column) -> Column:
    """Text for a feature, its value as text, and its band."""
    units = F.format_number(v.try_cast("double"), 0)
    shown = F.when((f == "quantity_in_commerce") & (band == fv.ELEVATED), units).otherwise(v)
    template = (
        F.when(band == fv.ELEVATED, _pick(fv.ELEVATED_TEXT, f, F.lit(fv.ELEVATED_OTHER)))
        .when(band == fv.REDUCED, _pick(fv.REDUCED_TEXT, f, F.lit(fv.REDUCED_OTHER)))
        .otherwise(F.lit(fv.NEUTRAL_TEXT)))
    part = F.when(band == fv.NEUTRAL, _pick(fv.EXPLANATION_LABELS, f, f)).otherwise(F.coalesce(shown, F.lit("None")))
    return F.replace(template, F.lit("{}"), part)


def _described(f: str, v: Column, band: Column) -> Column:
    """The same text for a feature known by name: only its own templates are built."""
    def filled(template, value):
        if "{}" not in template:
            return F.lit(template)
        head, tail = template.split("{}")
        return F.concat(F.lit(head), F.coalesce(value, F.lit("None")), F.lit(tail))

    shown = F.format_number(v.try_cast("double"), 0) if f == "quantity_in_commerce" else v
    return (
        F.when(band == fv.ELEVATED, filled(fv.ELEVATED_TEXT.get(f, fv.ELEVATED_OTHER), shown))
        .when(band == fv.REDUCED, filled(fv.REDUCED_TEXT.get(f, fv.REDUCED_OTHER), v))
        .otherwise(F.lit(fv.NEUTRAL_TEXT.replace("{}", fv.EXPLANATION_LABELS[f])))
    )


def factor_badge(c: Column) -> Column:
    return (
        F.when(c == fv.ELEVATED, fv.BADGES[fv.ELEVATED])
        .when(c == fv.REDUCED, fv.BADGES[fv.REDUCED])
        .otherwise(fv.BADGES[fv.NEUTRAL])
    )


def top_risk_factors(df: DataFrame, n: int = 5) -> DataFrame:
    """``risk_factors``: the ``n`` largest contributions by size; ties keep the order of ``contributions``.

    Values and texts are made only for the features that are kept; the whole step stays in generated code.
    """
    order = df.schema["contributions"].dataType.fieldNames()
    sizes = {f: (-F.abs(F.col(f"contributions.{f}"))).alias("size") for f in order}
    sized = F.array(*[F.struct(sizes[f], F.lit(i).alias("place")) for i, f in enumerate(order)])

    def factor(f):
        impact, value = F.col(f"contributions.{f}"), F.col(f).cast("string")
        band = impact_band(impact)
        return F.struct(
            F.lit(f).alias("feature"), F.lit(fv.EXPLANATION_LABELS[f]).alias("feature_name"), value.alias("value"),
            round_half(impact, 4).alias("importance"), band.alias("impact"), _described(f, value, band).alias("description"))

    top = df.withColumn("_top", F.slice(F.sort_array(sized), 1, n)["place"])
    # The kept ones alone are sorted with their texts; the others stay null and come last.
    kept = F.array(*[
        F.when(F.array_contains("_top", i), F.struct(sizes[f], F.lit(i).alias("place"), factor(f).alias("factor")))
        for i, f in enumerate(order)])
    return top.withColumn("_kept", F.sort_array(F.array_compact(kept))).withColumn("risk_factors", F.col("_kept")["factor"]).drop(
        "_top", "_kept")


def is_high(df_prediction="prediction", probability="probability") -> Column:
    return (F.col(df_prediction) == 1) | (F.col(probability) >= 0.5)


def _fill(template: str, **parts: Column) -> Column:
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("N/A")))
    return out


def risk_narrative(df: DataFrame, model_name: str = fv.NARRATIVE_MODEL) -> DataFrame:
    """``explanation``: the score, what raised or lowered it, and what it means, as text. ``model_name`` stands in it for the model."""
    pct = F.round((F.col("probability") * 100).cast("decimal(38,8)"), 1).cast("decimal(20,1)")

    def names(band, n):
        chosen = F.filter("risk_factors", lambda x: x["impact"] == band)
        return F.array_join(F.slice(chosen["feature_name"], 1, n), ", ")

    up, down = names(fv.ELEVATED, 3), names(fv.REDUCED, 2)
    maker, cls = F.col("name_manufacturer"), F.col("classification")
    high = F.concat(
        _fill(fv.NARRATIVE_HIGH, pct=pct, model=F.lit(model_name)),
        F.when(up != "", _fill(fv.NARRATIVE_HIGH_FACTORS, names=up)).otherwise(""),
        _fill(fv.NARRATIVE_HIGH_END, manufacturer=maker, classification=cls))
    low = F.concat(
        _fill(fv.NARRATIVE_LOW, pct=pct, model=F.lit(model_name)),
        F.when(down != "", _fill(fv.NARRATIVE_LOW_FACTORS, names=down)).otherwise(""),
        _fill(fv.NARRATIVE_LOW_END, manufacturer=maker))
    return df.withColumn("explanation", F.when(is_high(), high).otherwise(low))


def maintenance_recommendation(df: DataFrame) -> DataFrame:
    many = F.coalesce(F.col("event_count") > 5, F.lit(False))
    implanted = F.coalesce(F.upper("implanted") == "YES", F.lit(False))
    high = F.array(
        *[F.lit(x) for x in fv.PROTOCOL_HIGH_START],
        F.when(many, fv.PROTOCOL_HIGH_MANY_EVENTS).otherwise(fv.PROTOCOL_HIGH_FEW_EVENTS),
        F.when(implanted, fv.PROTOCOL_HIGH_IMPLANTED).otherwise(fv.PROTOCOL_HIGH_EXTERNAL),
        F.lit(fv.PROTOCOL_HIGH_END), F.lit(""), F.lit(fv.DISCLAIMER))
    low = F.array(*[F.lit(x) for x in fv.PROTOCOL_LOW], F.lit(""), F.lit(fv.DISCLAIMER))
    return df.withColumn(
        "maintenance_recommendation", F.array_join(F.when(is_high(), high).otherwise(low), "\n"))


def fold_onehot(contribs: DataFrame, slots: DataFrame, id_col: str = "id") -> DataFrame:
    """Sum slot contributions (id, slot, impact) to features by the exact slot -> feature map.

    The map has one row per model input, far below the broadcast bound; rows are combined before the shuffle.
    """
    return (
        contribs.join(F.broadcast(slots), "slot")
        .groupBy(id_col, "feature")
        .agg(F.sum("impact").alias("impact"))
    )
