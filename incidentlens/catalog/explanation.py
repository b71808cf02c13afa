import uuid

from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.catalog.cleaning import EXTRA as TRAINING
from incidentlens.functions.frames import risk_bands
from incidentlens.operators import explain as ops
from incidentlens.plans.assess import banded, explained
from incidentlens.plans.materialize import materialize, shared_dir
from incidentlens.plans.training_frame import training_frame
from incidentlens.sources import ledger, tables


TEXT_ROWS = 25_000  # rows of a file that texts are made from


def scored_features(t):
    """Training rows with the score and user of the order they came from."""
    rows = training_frame(t.events, t.devices, t.manufacturers, "v2")
    scores = t.predictions.select(
        F.col("id").cast("string").alias("order_id"), "user_id", "prediction", F.col("risk_score").alias("probability"))
    return rows.withColumn("order_id", F.substring_index("id", "-", 1)).join(scores, "order_id").drop("order_id", "target")


RULES = {
    "risk_class": "case when risk_class in ('3', 'III', 'Class 3') then 0.35 else 0.1 end",
    "event_count": "case when event_count > 5 then 0.30 else 0.05 end",
    "manufacturer_event_count": "case when manufacturer_event_count > 50 then 0.25 else 0.05 end",
    "implanted": "case when upper(implanted) = 'YES' then 0.20 else -0.05 end",
    "classification": "case when classification like '%Cardiovascular%' or classification like '%Anesthesiology%' then 0.15 else 0.02 end",
    "type": "case when type like '%Recall%' then 0.15 else 0.01 end",
    "quantity_in_commerce": "case when quantity_in_commerce > 10000 then 0.05 else 0.01 end",
    "status": "0.05", "country_event": "0.02", "country_device": "0.02", "name_manufacturer": "0.05",
    "event_year": "0.01", "event_month": "0.01",
}


def _sql(text):
    return "'" + text.replace("'", "''") + "'"


def _described(texts, other, shown):
    whens = " ".join(f"when feature = '{f}' then replace({_sql(x)}, '{{}}', coalesce({shown}, 'None'))" for f, x in texts.items())
    return f"case {whens} else {_sql(other)} end"


LABEL = "case feature " + " ".join(f"when '{f}' then {_sql(x)}" for f, x in fv.EXPLANATION_LABELS.items()) + " end"
UNITS = "format('{:,}', cast(round_even(cast(value as double), 0) as bigint))"
HIGH = "prediction = 1 or probability >= 0.5"

EXTRA = {
    "merged": TRAINING["merged"], "counted": TRAINING["counted"], "frame_v2": TRAINING["frame_v2"],
    "scored": """select f.*, p.prediction, p.risk_score as probability, p.user_id from frame_v2 f
        join md_predictions p on cast(p.id as string) = split_part(f.id, '-', 1)""",
    "rules": " union all ".join(
        f"select id, '{f}' as feature, {i} as pos, cast({RULES[f]} as double) as impact, cast({f} as string) as value from scored"
        for i, f in enumerate(fv.RULE_ORDER)),
    "factors": f"""
        select id, feature, {LABEL} as feature_name, value, cast(round(cast(impact as decimal(38,8)), 4) as double) as importance,
          band as impact, case when band = 'ELEVATED_RISK' then {_described({k: v for k, v in fv.ELEVATED_TEXT.items() if k != 'quantity_in_commerce'} | {'quantity_in_commerce': fv.ELEVATED_TEXT['quantity_in_commerce']}, fv.ELEVATED_OTHER, f"case when feature = 'quantity_in_commerce' then {UNITS} else value end")}
            when band = 'REDUCED_RISK' then {_described(fv.REDUCED_TEXT, fv.REDUCED_OTHER, 'value')}
            else {LABEL} || ' has a baseline neutral contribution in the model.' end as description, place
        from (select *, row_number() over (partition by id order by abs(impact) desc, pos) as place,
            case when impact > 0.02 then 'ELEVATED_RISK' when impact < -0.02 then 'REDUCED_RISK' else 'NEUTRAL' end as band
          from rules) t where place <= 5""",
    "named": """select id, string_agg(case when impact = 'ELEVATED_RISK' and up <= 3 then feature_name end, ', ' order by place) as up,
          string_agg(case when impact = 'REDUCED_RISK' and down <= 2 then feature_name end, ', ' order by place) as down
        from (select *, count(*) filter (impact = 'ELEVATED_RISK') over (partition by id order by place) as up,
            count(*) filter (impact = 'REDUCED_RISK') over (partition by id order by place) as down from factors) t
        group by id""",
}


def _factors(t):
    return ops.top_risk_factors(ops.rule_attributions(scored_features(t)))


def _flat(rows):
    """``risk_factors`` as one row per factor.

    The rows without a factor are dropped afterwards: for a plain ``posexplode`` Spark itself filters by the array's size below the
    projections, and makes all factors once more there, each with every part that it shares with others written out.
    """
    placed = rows.select("id", F.posexplode_outer("risk_factors").alias("place", "f")).filter("place is not null")
    return placed.select("id", "place", "f.*")


def _flat_factors(t):
    return _flat(_factors(t))


def _bands(t):
    rows = ops.contribution_rows(ops.rule_attributions(scored_features(t)), "id")
    return rows.select("id", "feature", ops.impact_band(F.col("impact")).alias("band"))


def _descriptions(t):
    """Every feature of every row described in all three bands."""
    rows = scored_features(t)
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in fv.FEATURES])
    cases = rows.select("id", F.explode(cells).alias("c")).select("id", "c.*").withColumn(
        "band", F.explode(F.array(F.lit(fv.ELEVATED), F.lit(fv.REDUCED), F.lit(fv.NEUTRAL))))
    return cases.groupBy("feature", "band", ops.factor_description(
        F.col("feature"), F.col("value"), F.col("band")).alias("description")).agg(F.count("*").alias("n"))


def _folded(t):
    """Order lines as slot contributions: the line number is the slot, its discount the impact."""
    contribs = t.raw("lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("slot"), F.col("l_discount").alias("impact"))
    slots = t.raw("lineitem").select(F.col("l_linenumber").alias("slot")).distinct().withColumn(
        "feature", F.when(F.col("slot") <= 3, "type").when(F.col("slot") <= 5, "status").otherwise("event_year"))
    return ops.fold_onehot(contribs, slots).select("id", "feature", F.round(
        F.col("impact").cast("decimal(38,8)"), 6).cast("double").alias("impact"))


def _assessed(scored):
    return banded(explained(scored)).withColumn("features_used", F.array().cast(
        "array<struct<feature:string,feature_name:string,value:string,source:string>>"))


def _batched(t):
    """Two of three batches stored, then all three, one of them twice: each counts once, in both tables."""
    # Scores are written once for the three calls; texts, some 2 KB a row, are made of the rows that a call stores.
    rows = _assessed(materialize(scored_features(t), file_rows=TEXT_ROWS)).withColumn("batch_id", (F.col("user_id") % 3).cast("string"))
    root = f"{shared_dir(t.spark)}/incidentlens-batches-{uuid.uuid4().hex}"
    for part in (rows.filter("batch_id < 2"), rows, rows.filter("batch_id = 1")):
        ledger.write_batches(part, root)
    audited = ledger.read_batches(t.spark, root, "audit").groupBy("batch_id").agg(F.count("*").alias("n_audited"))
    stored = ledger.read_batches(t.spark, root, "predictions")
    return stored.join(audited, "batch_id").select("batch_id", "id", "user_id", "risk_level", "risk_percentage", "n_audited")


def _written(t):
    """Store assessed rows and read them back."""
    rows = _assessed(scored_features(t))
    path = f"{shared_dir(t.spark)}/incidentlens-predictions-{uuid.uuid4().hex}"
    tables.write_predictions(rows, path)
    return t.spark.read.parquet(path).select(
        "id", "user_id", "risk_level", "risk_percentage", "explanation",
        F.size(F.from_json("risk_factors", F.lit("array<struct<feature:string>>"))).alias("n_factors"))


NARRATIVE_SQL = f"""
    case when {HIGH} then 'The trained XGBoost machine learning model estimated an elevated failure/risk score of '
        || cast(cast(round(cast(probability * 100 as decimal(38,8)), 1) as decimal(20,1)) as string)
        || '% (High Risk) based on historical medical-device event patterns. '
        || case when up is not null then 'Key contributing risk factors include ' || up || '. ' else '' end
        || 'Historical patterns for manufacturer ''' || name_manufacturer || ''' and classification ''' || classification
        || ''' exhibit characteristics aligned with elevated maintenance attention.'
      else 'The trained XGBoost machine learning model estimated a low failure/risk score of '
        || cast(cast(round(cast(probability * 100 as decimal(38,8)), 1) as decimal(20,1)) as string)
        || '% (Low Risk) based on historical medical-device event patterns. '
        || case when down is not null then 'Mitigating factors such as ' || down || ' correlate with lower adverse event rates. ' else '' end
        || 'The device characteristics for manufacturer ''' || name_manufacturer
        || ''' remain within baseline operational parameters in the historical distribution.' end"""
LEVEL = f"case when {HIGH} then 'HIGH' else 'LOW' end"
PERCENT = "cast(round(cast(probability * 100 as decimal(38,8)), 2) as double)"

QUERIES = {
    "rule_attributions": lambda t: ops.contribution_rows(ops.rule_attributions(scored_features(t)), "id"),
    "top_risk_factors": _flat_factors,
    "impact_band": _bands,
    "factor_description": _descriptions,
    "risk_narrative": lambda t: ops.risk_narrative(_factors(t)).select("id", "explanation"),
    "maintenance_recommendation": lambda t: ops.maintenance_recommendation(scored_features(t)).select(
        "id", "maintenance_recommendation"),
    "factor_badge": lambda t: _flat_factors(t).select(
        "id", "feature", ops.factor_badge(F.col("impact")).alias("badge")),
    "fold_onehot": _folded,
    "audit_rows": lambda t: tables.audit_rows(risk_bands(t.predictions)),
    "write_predictions": _written,
    "write_batches": _batched,
}

ORACLE = {
    "rule_attributions": "select id, feature, impact from rules",
    "top_risk_factors": """select id, place - 1 as place, feature, feature_name, value, importance, impact, description
        from factors""",
    "impact_band": """select id, feature, case when impact > 0.02 then 'ELEVATED_RISK' when impact < -0.02
        then 'REDUCED_RISK' else 'NEUTRAL' end as band from rules""",
    "factor_description": f"""select feature, band, description, count(*) as n from (
        select feature, 'ELEVATED_RISK' as band, {_described(fv.ELEVATED_TEXT, fv.ELEVATED_OTHER, f"case when feature = 'quantity_in_commerce' then {UNITS} else value end")} as description from rules
        union all select feature, 'REDUCED_RISK', {_described(fv.REDUCED_TEXT, fv.REDUCED_OTHER, 'value')} from rules
        union all select feature, 'NEUTRAL', {LABEL} || ' has a baseline neutral contribution in the model.' from rules) t
        group by feature, band, description""",
    "risk_narrative": f"select s.id, {NARRATIVE_SQL} as explanation from scored s join named n on n.id = s.id",
    "maintenance_recommendation": f"""select id, case when {HIGH} then concat_ws(chr(10), {', '.join(_sql(x) for x in fv.PROTOCOL_HIGH_START)},
          case when event_count > 5 then {_sql(fv.PROTOCOL_HIGH_MANY_EVENTS)} else {_sql(fv.PROTOCOL_HIGH_FEW_EVENTS)} end,
          case when upper(implanted) = 'YES' then {_sql(fv.PROTOCOL_HIGH_IMPLANTED)} else {_sql(fv.PROTOCOL_HIGH_EXTERNAL)} end,
          {_sql(fv.PROTOCOL_HIGH_END)}, '', {_sql(fv.DISCLAIMER)})
        else concat_ws(chr(10), {', '.join(_sql(x) for x in fv.PROTOCOL_LOW)}, '', {_sql(fv.DISCLAIMER)}) end
        as maintenance_recommendation from scored""",
    "factor_badge": """select id, feature, case impact when 'ELEVATED_RISK' then 'Elevated Risk Impact'
        when 'REDUCED_RISK' then 'Reduced Risk Impact' else 'Neutral' end as badge from factors""",
    "fold_onehot": """select l_orderkey as id, case when l_linenumber <= 3 then 'type' when l_linenumber <= 5 then 'status'
        else 'event_year' end as feature, cast(round(cast(sum(l_discount) as decimal(38,8)), 6) as double) as impact
        from lineitem group by all""",
    "audit_rows": """select user_id, 'PREDICTION_CREATED' as action, 'Risk assessment created for ' || name_manufacturer
        || ' (' || classification || ') - Result: ' || risk_level || ' (' ||
        cast(cast(round(cast(risk_score * 100 as decimal(38,8)), 2) as double) as string) || '%)' as description,
        cast(null as string) as ip_address from md_predictions""",
    "write_batches": f"""select cast(user_id % 3 as string) as batch_id, s.id, user_id, {LEVEL} as risk_level,
        {PERCENT} as risk_percentage, count(*) over (partition by user_id % 3) as n_audited from scored s""",
    "write_predictions": f"""select s.id, user_id, {LEVEL} as risk_level, {PERCENT} as risk_percentage,
        {NARRATIVE_SQL} as explanation, 5 as n_factors from scored s join named n on n.id = s.id""",
}
