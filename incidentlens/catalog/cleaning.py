from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.functions import cleaning as c
from incidentlens.functions import frames
from incidentlens.operators.training import labelled
from incidentlens.plans.training_frame import merged_events, training_frame

TARGET_V1 = """case when tok in ('CLASSI', 'CLASS1', 'I', '1') then 0
    when tok in ('CLASSII', 'CLASS2', 'II', '2', 'CLASSIII', 'CLASS3', 'III', '3') then 1 end"""
TARGET_V2 = """case when tok in ('CLASS1', 'CLASSI', 'I', '1', 'CLASS2', 'CLASSII', 'II', '2') then 0
    when tok in ('CLASS3', 'CLASSIII', 'III', '3', 'VOLUNTARYRECALL') then 1 end"""
EXTRA = {
    "tokens": """select id, action_classification,
        coalesce(regexp_replace(upper(action_classification), '[^A-Z0-9]', '', 'g'), '') as tok from md_events""",
    "merged": """
        select e.id, e.device_id, e.type, e.status, e.country as country_event, e.action_classification,
          e.event_year, e.event_month, d.manufacturer_id, d.classification, d.implanted, d.country as country_device,
          d.quantity_in_commerce, d.risk_class, m.name as name_manufacturer
        from md_events e join md_devices d on e.device_id = d.id
          left join md_manufacturers m on d.manufacturer_id = m.id""",
    "counted": """
        select g.*, dc.n as event_count, mc.n as manufacturer_event_count from merged g
          left join (select device_id, count(*) as n from merged group by device_id) dc on dc.device_id = g.device_id
          left join (select manufacturer_id, count(*) as n from merged group by manufacturer_id) mc
            on mc.manufacturer_id = g.manufacturer_id""",
    "frame_v1": f"""
        select id, {TARGET_V1} as target,
          trim(type) as type, trim(status) as status, coalesce(trim(classification), '') as classification,
          coalesce(trim(risk_class), '') as risk_class, trim(country_event) as country_event,
          coalesce(trim(country_device), '') as country_device, coalesce(upper(trim(implanted)), 'Unknown') as implanted,
          coalesce(trim(name_manufacturer), '') as name_manufacturer, quantity_in_commerce,
          cast(event_count as double) as event_count, cast(manufacturer_event_count as double) as manufacturer_event_count,
          cast(event_year as double) as event_year, cast(event_month as double) as event_month
        from (select *, coalesce(regexp_replace(upper(action_classification), '[^A-Z0-9]', '', 'g'), '') as tok
              from counted) t where {TARGET_V1} is not null""",
    "frame_v2": f"""
        select id, {TARGET_V2} as target,
          coalesce(nullif(trim(type), ''), 'Unknown') as type, coalesce(nullif(trim(status), ''), 'Unknown') as status,
          coalesce(nullif(trim(classification), ''), 'Unknown') as classification,
          coalesce(nullif(trim(risk_class), ''), 'Unknown') as risk_class,
          coalesce(nullif(trim(country_event), ''), 'Unknown') as country_event,
          coalesce(nullif(trim(country_device), ''), 'Unknown') as country_device,
          coalesce(nullif(trim(implanted), ''), 'Unknown') as implanted,
          coalesce(nullif(trim(name_manufacturer), ''), 'Unknown') as name_manufacturer, quantity_in_commerce,
          cast(event_count as double) as event_count, cast(manufacturer_event_count as double) as manufacturer_event_count,
          cast(event_year as double) as event_year, cast(event_month as double) as event_month
        from (select *, coalesce(regexp_replace(upper(action_classification), '[^A-Z0-9]', '', 'g'), '') as tok
              from counted) t where {TARGET_V2} is not null""",
}
ROUNDED = "cast(round(cast(risk_score * 100 as decimal(38,8)), 2) as double)"


def _gauge(t):
    p = frames.risk_bands(t.predictions)
    pct = F.when(F.col("label") == 1, F.col("risk_percentage") * 2 - 50).otherwise(F.col("risk_percentage"))
    return p.select("id", c.gauge_clamp(pct).alias("gauge"), c.gauge_is_high(pct, F.col("risk_level")).alias("is_high"))


def _messy_quantity():
    q = F.col("quantity_in_commerce")
    return (
        F.when(q.isNull(), "NaN").when(q == 0, "1,000").when(F.col("risk_class") == "1", F.concat(F.lit(" "), q.cast("string")))
        .otherwise(q.cast("string")))


def _nested(t):
    """Store rows without provenance, read them back and show the rebuilt entries."""
    frame = training_frame(t.events, t.devices, t.manufacturers, "v2")
    stored = frame.withColumns({"risk_factors": F.lit(None).cast("string"), "features_used": F.lit("[]")})
    back = frames.nested_json(stored, encode=False)
    return back.select("id", F.explode("features_used").alias("f")).select(
        "id", "f.feature", "f.feature_name", "f.source", F.coalesce("f.value", F.lit("")).alias("value")
    )


def _aliased(t):
    d = t.devices.withColumnRenamed("implanted", "implantation_status")
    return frames.column_alias_fallback(d, frames.DEVICE_ALIASES).select("id", "implanted")


QUERIES = {
    "clean_text": lambda t: t.events.select(
        "id", c.clean_text(F.col("action_classification")).alias("cleaned")),
    "class_token": lambda t: t.events.select(
        "id", c.class_token(F.col("action_classification")).alias("tok")),
    "risk_target_v1": lambda t: t.events.select(
        "id", c.risk_target_v1(F.col("action_classification")).alias("target")),
    "risk_target_v2": lambda t: t.events.select(
        "id", c.risk_target_v2(F.col("action_classification")).alias("target")),
    "drop_unlabelled": lambda t: frames.drop_unlabelled(labelled(t.events, "v2"), "target").select(
        "id", "action_classification", "target"),
    "upper_implanted": lambda t: t.devices.select("id", c.upper_implanted(F.col("implanted")).alias("implanted")),
    "fill_unknown": lambda t: frames.fill_unknown(
        t.devices.select("id", "classification", "risk_class", "implanted"),
        ["classification", "risk_class", "implanted"]),
    "to_numeric": lambda t: t.devices.select("id", c.to_numeric(_messy_quantity()).alias("quantity")),
    "event_year_month": lambda t: frames.event_year_month(t.events.select("id", "date")).select(
        "id", "event_year", "event_month"),
    "feature_projection": lambda t: frames.feature_projection(t.devices, keep=["id"]),
    "column_alias_fallback": _aliased,
    "map_implant_status": lambda t: t.requests.select(
        "request_id", c.map_implant_status(F.col("implanted")).alias("implanted")),
    "risk_bands": lambda t: frames.risk_bands(t.predictions.drop("risk_level")).select(
        "id", "risk_percentage", "risk_level", "prediction_label"),
    "gauge_clamp": _gauge,
    "nested_json": _nested,
    "join_events_devices": lambda t: merged_events(t.events, t.devices).select(
        "id", "device_id", "manufacturer_id", "type", "country_event", "country_device", "risk_class"),
    "join_manufacturers": lambda t: merged_events(t.events, t.devices, t.manufacturers).select(
        "id", "device_id", "manufacturer_id", "name_manufacturer"),
    "training_frame": lambda t: training_frame(t.events, t.devices, t.manufacturers, "v2"),
    "training_frame_v1": lambda t: training_frame(t.events, t.devices, t.manufacturers, "v1"),
}

ORACLE = {
    "clean_text": "select id, coalesce(trim(action_classification), '') as cleaned from md_events",
    "class_token": "select id, tok from tokens",
    "risk_target_v1": f"select id, {TARGET_V1} as target from tokens",
    "risk_target_v2": f"select id, {TARGET_V2} as target from tokens",
    "drop_unlabelled": f"select id, action_classification, {TARGET_V2} as target from tokens where {TARGET_V2} is not null",
    "upper_implanted": "select id, coalesce(upper(implanted), 'Unknown') as implanted from md_devices",
    "fill_unknown": """select id, coalesce(classification, 'Unknown') as classification,
        coalesce(risk_class, 'Unknown') as risk_class, coalesce(implanted, 'Unknown') as implanted from md_devices""",
    "to_numeric": """select id, case when quantity_in_commerce = 0 then null else quantity_in_commerce end as quantity
        from md_devices""",
    "event_year_month": "select id, event_year, event_month from md_events",
    "feature_projection": """select id, cast(null as string) as type, cast(null as string) as status, classification,
        risk_class, cast(null as string) as country_event, cast(null as string) as country_device, implanted,
        cast(null as string) as name_manufacturer, quantity_in_commerce, cast(null as double) as event_count,
        cast(null as double) as manufacturer_event_count, cast(null as double) as event_year,
        cast(null as double) as event_month from md_devices""",
    "column_alias_fallback": "select id, implanted from md_devices",
    "map_implant_status": """select request_id, case when upper(implanted) like '%YES%' or upper(implanted)
        like '%IMPLANTED%' then 'YES' else 'NO' end as implanted from md_requests""",
    "risk_bands": f"""select id, {ROUNDED} as risk_percentage,
        case when prediction = 1 or risk_score >= 0.5 then 'HIGH' else 'LOW' end as risk_level,
        case when prediction = 1 or risk_score >= 0.5 then 'High Risk' else 'Low Risk' end as prediction_label
        from md_predictions""",
    "gauge_clamp": f"""select id, greatest(0.0, least(100.0, pct)) as gauge,
        risk_level = 'HIGH' or greatest(0.0, least(100.0, pct)) >= 50 as is_high
        from (select *, case when label = 1 then {ROUNDED} * 2 - 50 else {ROUNDED} end as pct from md_predictions) t""",
    "nested_json": " union all ".join(
        f"""select id, '{f}' as feature, '{label}' as feature_name, 'Recorded evaluation' as source,
        coalesce(cast({f} as string), '') as value from frame_v2""" for f, label in fv.PROVENANCE_LABELS.items()),
    "join_events_devices": """select id, device_id, manufacturer_id, type, country_event, country_device, risk_class
        from merged""",
    "join_manufacturers": "select id, device_id, manufacturer_id, name_manufacturer from merged",
    "training_frame": "select * from frame_v2",
    "training_frame_v1": "select * from frame_v1",
}
