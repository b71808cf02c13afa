import uuid

from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.catalog.cleaning import EXTRA as TRAINING
from incidentlens.operators import aggregates as agg
from incidentlens.operators import joins, paging, search
from incidentlens.functions.frames import risk_bands
from incidentlens.operators.training import labelled
from incidentlens.plans.materialize import materialize, shared_dir
from incidentlens.plans.training_frame import merged_events

EXTRA = {"merged": TRAINING["merged"], "tokens": TRAINING["tokens"]}


def _makers(t):
    """Manufacturers from the first of the nations, as the list whose events are wanted."""
    return t.manufacturers.filter("parent_company like 'NATION_1%'").select(F.col("id").alias("manufacturer_id"))


def _dashboard(t):
    one = agg.admin_dashboard(t.users, t.predictions, t.events, t.devices, t.manufacturers)
    flat = one.select(
        *[c for c in one.columns if c not in ("user_distribution", "risk_distribution")],
        *[F.col("user_distribution")[r].alias(f"users_{r.lower()}")
          for r in ("ADMIN", "BIOMEDICAL_ENGINEER", "MAINTENANCE_TEAM")],
        *[F.col("risk_distribution")[r].alias(f"risk_{r.lower()}") for r in ("HIGH", "LOW")])
    return flat


def _countries_chunks(t):
    third = t.events.select("id", "type")
    return agg.concat_chunks(
        third.filter("type = 'Recall'"), third.filter("type = 'Safety alert'"), third.filter("type = 'Field Safety Notice'"))


def _volumes(t):
    """Per device: its own events against all events of its manufacturer."""
    counts = agg.event_counts(t.events, t.devices)
    own = agg.count_by_device(counts, "n")
    makers = agg.count_by_manufacturer(counts, "n")
    rows = (
        t.devices.select(F.col("id").alias("device_id"), "manufacturer_id")
        .join(own, "device_id", "left").join(makers, "manufacturer_id", "left"))
    return agg.event_volume_comparison(rows, key="device_id")


def _labelled_predictions(t):
    return risk_bands(t.predictions)


SUMMARY = "id, created_at, name_manufacturer, classification, risk_class, prediction_label, risk_score, risk_percentage, risk_level, user_id"
EXTRA["banded"] = """
    select *, cast(round(cast(risk_score * 100 as decimal(38,8)), 2) as double) as risk_percentage,
      case when risk_level = 'HIGH' then 'High Risk' else 'Low Risk' end as prediction_label from md_predictions"""

def _index(t, df, order):
    path = f"{shared_dir(t.spark)}/incidentlens-index-{uuid.uuid4().hex}"
    # Small ranges, so that the test tables have many.
    paging.build_order_index(df, order, path, range_rows=max(50, df.count() // 40))
    return path


def _deep_logs(t):
    """A hundred log entries from the middle of the newest-first order, with their users."""
    path = _index(t, t.audit_logs, ["-created_at", "-id"])
    page = paging.indexed_page(t.spark, path, 100, t.raw("events").count() // 2, with_total=True)
    total = page.select("id", "total")
    return joins.logs_with_users(page.drop("total"), t.users).join(total, "id")


def _deep_devices(t):
    """Forty devices from the middle of those whose names contain a term, in the order of their names."""
    path = _index(t, t.devices.filter("name is not null").select("id", "name", "classification"), ["name", "id"])
    found = F.col("name").ilike("%a%")
    half = t.devices.filter(found).count() // 2
    return paging.indexed_page(t.spark, path, 40, half, where=found, with_total=True)


QUERIES = {
    "deep_page_logs": _deep_logs,
    "deep_page_devices": _deep_devices,
    "enrich_event_counts": lambda t: joins.enrich_event_counts(materialize(merged_events(t.events, t.devices))).select(
        "id", "device_id", "manufacturer_id", "event_count", "manufacturer_event_count"),
    "semi_join_events": lambda t: joins.semi_join_events(t.events, t.devices, _makers(t)),
    "logs_with_users": lambda t: joins.logs_with_users(t.audit_logs, t.users),
    "users_with_counts": lambda t: joins.users_with_counts(t.users, t.predictions),
    "predictions_with_users": lambda t: joins.predictions_with_users(t.predictions, t.users).select(
        "id", "user_id", "risk_level", "user_name", "user_role"),
    "count_by_device": lambda t: agg.count_by_device(agg.event_counts(t.events, t.devices), "n"),
    "count_by_manufacturer": lambda t: agg.count_by_manufacturer(
        agg.event_counts(t.events, t.devices), "n"),
    "top_value_by_group": lambda t: agg.top_value_by_group(t.events, "device_id", "type"),
    "avg_positive_quantity": lambda t: agg.avg_positive_quantity(t.devices, "manufacturer_id"),
    "latest_year": lambda t: agg.latest_year(t.events),
    "latest_month_of_year": lambda t: agg.latest_month_of_year(t.events),
    "distinct_event_types": lambda t: agg.distinct_event_types(t.events),
    "distinct_classifications": lambda t: agg.distinct_classifications(t.devices),
    "distinct_risk_classes": lambda t: agg.distinct_risk_classes(t.devices),
    "metadata_options": lambda t: agg.metadata_options(t.manufacturers, t.devices, t.events),
    "class_distribution": lambda t: agg.class_distribution(labelled(t.events, "v2")),
    "admin_dashboard": _dashboard,
    "users_by_role": lambda t: agg.users_by_role(t.users),
    "risk_distribution": lambda t: agg.risk_distribution(t.predictions),
    "user_dashboard_kpis": lambda t: agg.user_dashboard_kpis(t.predictions),
    "event_volume_comparison": _volumes,
    "countries": lambda t: agg.countries(t.events, t.devices),
    "concat_chunks": _countries_chunks,
    "search_manufacturers": lambda t: search.search_manufacturers(t.manufacturers, "SUPPLIER#0_0", page=2, limit=15),
    "search_devices": lambda t: search.search_devices(t.devices, "Ring", page=1, limit=100),
    "prediction_history": lambda t: search.prediction_history(
        _labelled_predictions(t), 7, search="a", risk_level="high", limit=50, offset=2),
    "prediction_detail": lambda t: search.prediction_detail(_labelled_predictions(t), 42, 1, True),
    "admin_predictions": lambda t: search.admin_predictions(
        _labelled_predictions(t), t.users, risk_level="low", search="safety", limit=200, offset=10),
    "admin_users": lambda t: search.admin_users(
        t.users, t.predictions, search="customer#", role="maintenance_team", is_active=True, limit=100, offset=5),
    "audit_trail": lambda t: search.audit_trail(t.audit_logs, t.users, action="error", limit=300, offset=20),
    "resort_by_time": lambda t: search.prediction_history(
        _labelled_predictions(t), 11, limit=100, ascending=True),
    "head_examples": lambda t: search.head_examples(labelled(t.events, "v2"), "target").select("id", "target", "type"),
}

ORACLE = {
    "deep_page_logs": """select l.id, l.user_id, case when u.id is not null then u.full_name
        when l.user_id is not null then 'User #' || l.user_id end as user_name, u.email as user_email,
        u.role as user_role, l.action, l.description, l.ip_address, l.created_at, l.total
        from (select *, row_number() over (order by created_at desc, id desc) as rn, count(*) over () as total
          from md_audit_logs) l left join md_users u on l.user_id = u.id
        where rn > total // 2 and rn <= total // 2 + 100""",
    "deep_page_devices": """select id, name, classification, total from (select id, name, classification,
          row_number() over (order by name, id) as rn, count(*) over () as total from md_devices where name ilike '%a%') d
        where rn > total // 2 and rn <= total // 2 + 40""",
    "enrich_event_counts": """select g.id, g.device_id, g.manufacturer_id, dc.n as event_count,
        mc.n as manufacturer_event_count from merged g
        left join (select device_id, count(*) as n from merged group by device_id) dc on dc.device_id = g.device_id
        left join (select manufacturer_id, count(*) as n from merged group by manufacturer_id) mc
          on mc.manufacturer_id = g.manufacturer_id""",
    "semi_join_events": """select * from md_events where device_id in (select id from md_devices
        where manufacturer_id in (select id from md_manufacturers where parent_company like 'NATION_1%'))""",
    "logs_with_users": """select l.id, l.user_id, case when u.id is not null then u.full_name
        when l.user_id is not null then 'User #' || l.user_id end as user_name, u.email as user_email,
        u.role as user_role, l.action, l.description, l.ip_address, l.created_at
        from md_audit_logs l left join md_users u on l.user_id = u.id""",
    "users_with_counts": """select u.*, coalesce(n, 0) as assessment_count from md_users u left join
        (select user_id, count(*) as n from md_predictions group by user_id) c on c.user_id = u.id""",
    "predictions_with_users": """select p.id, p.user_id, p.risk_level, coalesce(u.full_name, 'Unknown') as user_name,
        coalesce(u.role, 'Unknown') as user_role from md_predictions p left join md_users u on p.user_id = u.id""",
    "count_by_device": "select device_id, count(*) as event_count from merged group by device_id",
    "count_by_manufacturer": """select manufacturer_id, count(*) as manufacturer_event_count from merged
        group by manufacturer_id""",
    "top_value_by_group": """select device_id, type, n from (select device_id, type, count(*) as n,
        row_number() over (partition by device_id order by count(*) desc, type) as rn
        from md_events group by device_id, type) t where rn = 1""",
    "avg_positive_quantity": """select manufacturer_id, cast(round(cast(avg(case when quantity_in_commerce > 0
        then quantity_in_commerce end) as decimal(38,8)), 1) as double) as avg_quantity
        from md_devices group by manufacturer_id""",
    "latest_year": """select coalesce(max(case when event_year between 1980 and 2035 then event_year end), 2025)
        as latest_year from md_events""",
    "latest_month_of_year": """select event_year, max(event_month) as latest_month from md_events
        where event_year is not null group by event_year""",
    "distinct_event_types": "select distinct type as value from md_events where type <> ''",
    "distinct_classifications": "select distinct classification as value from md_devices where classification <> ''",
    "distinct_risk_classes": "select distinct risk_class as value from md_devices where risk_class <> ''",
    "metadata_options": f"""
        select distinct 'types' as option, type as value from md_events where type <> ''
        union all select distinct 'classifications', classification from md_devices where classification <> ''
        union all select distinct 'risk_classes', risk_class from md_devices where risk_class <> ''
        union all select 'countries', c from (select upper(country) as c from md_events where country <> ''
          union select upper(country) from md_devices where country <> '') u
        union all select 'manufacturers', name from
          (select name from md_manufacturers order by name nulls first, id limit 100) n where name <> ''
        union all select 'statuses', s from (values {', '.join(f"('{s}')" for s in fv.STANDARD_STATUSES)}) v(s)
        union all select 'implanted_options', s from (values ('NO'), ('YES')) v(s)""",
    "class_distribution": f"""select target, count(*) as n, case when target = 1 then 'High Risk' else 'Low Risk' end
        as name from (select case when tok in ('CLASS1', 'CLASSI', 'I', '1', 'CLASS2', 'CLASSII', 'II', '2') then 0
          when tok in ('CLASS3', 'CLASSIII', 'III', '3', 'VOLUNTARYRECALL') then 1 end as target from tokens) t
        where target is not null group by target""",
    "admin_dashboard": """select * from
        (select count(*) as total_users, count(*) filter (is_active) as active_users,
          count(*) filter (role = 'ADMIN') as users_admin,
          count(*) filter (role = 'BIOMEDICAL_ENGINEER') as users_biomedical_engineer,
          count(*) filter (role = 'MAINTENANCE_TEAM') as users_maintenance_team from md_users) u,
        (select count(*) as total_assessments, count(*) filter (risk_level = 'HIGH') as high_risk_assessments,
          count(*) filter (risk_level = 'LOW') as low_risk_assessments,
          count(*) filter (risk_level = 'HIGH') as risk_high, count(*) filter (risk_level = 'LOW') as risk_low
          from md_predictions) p,
        (select count(*) as total_historical_events from md_events) e,
        (select count(*) as total_historical_devices from md_devices) d,
        (select count(*) as total_historical_manufacturers from md_manufacturers) m""",
    "users_by_role": "select role, count(*) as n from md_users group by role",
    "risk_distribution": """select 'HIGH' as risk_level, 'High Risk' as name, count(*) as n from md_predictions
        where risk_level = 'HIGH' union all select 'LOW', 'Low Risk', count(*) from md_predictions where risk_level = 'LOW'""",
    "user_dashboard_kpis": """select user_id, count(*) as total_assessments,
        count(*) filter (risk_level = 'HIGH') as high_risk, count(*) filter (risk_level = 'LOW') as low_risk,
        max(case when rn = 1 then id end) as latest_id, max(case when rn = 1 then risk_level end) as latest_risk_level
        from (select *, row_number() over (partition by user_id order by created_at desc, id desc) as rn
          from md_predictions) t where rn <= 10 group by user_id""",
    "event_volume_comparison": """
        select d.id as device_id, 'Device Events' as name, coalesce(n, 0) as events from md_devices d left join
          (select device_id, count(*) as n from merged group by device_id) c on c.device_id = d.id
        union all select d.id, 'Mfr Total Events', coalesce(n, 0) from md_devices d left join
          (select manufacturer_id, count(*) as n from merged group by manufacturer_id) c
          on c.manufacturer_id = d.manufacturer_id""",
    "countries": """select upper(country) as value from md_events where country <> ''
        union select upper(country) from md_devices where country <> ''""",
    "concat_chunks": "select id, type from md_events",
    "search_manufacturers": """select id, name, (select count(*) from md_manufacturers where name ilike '%SUPPLIER#0_0%')
        as total from md_manufacturers where name ilike '%SUPPLIER#0_0%' order by name, id limit 15 offset 15""",
    "search_devices": """select id, name, classification, (select count(*) from md_devices where name ilike '%Ring%')
        as total from md_devices where name ilike '%Ring%' order by name, id limit 100""",
    "prediction_history": f"""select {SUMMARY} from banded where user_id = 7 and risk_level = 'HIGH'
        and (name_manufacturer ilike '%a%' or classification ilike '%a%' or type ilike '%a%')
        order by created_at desc, id desc limit 50 offset 2""",
    "prediction_detail": "select * from banded where id = 42",
    "admin_predictions": f"""select p.*, coalesce(u.full_name, 'Unknown') as user_name,
        coalesce(u.role, 'Unknown') as user_role from (select {SUMMARY} from banded where risk_level = 'LOW'
          and (name_manufacturer ilike '%safety%' or classification ilike '%safety%' or type ilike '%safety%')
          order by created_at desc, id desc limit 200 offset 10) p left join md_users u on u.id = p.user_id""",
    "admin_users": """with f as (select * from md_users where role = 'MAINTENANCE_TEAM' and is_active
          and (full_name ilike '%customer#%' or email ilike '%customer#%'))
        select f.*, coalesce(n, 0) as assessment_count, (select count(*) from f) as total from f left join
          (select user_id, count(*) as n from md_predictions group by user_id) c on c.user_id = f.id
        order by created_at desc nulls last, f.id desc limit 100 offset 5""",
    "audit_trail": """select l.id, l.user_id, case when u.id is not null then u.full_name
        when l.user_id is not null then 'User #' || l.user_id end as user_name, u.email as user_email,
        u.role as user_role, l.action, l.description, l.ip_address, l.created_at
        from (select * from md_audit_logs where action = 'ERROR' order by created_at desc, id desc
          limit 300 offset 20) l left join md_users u on l.user_id = u.id""",
    "resort_by_time": f"""select {SUMMARY} from banded where user_id = 11 order by created_at desc, id desc limit 100""",
    "head_examples": """select id, target, type from (select *, row_number() over (partition by target order by id) as rn
        from (select e.*, case when tok in ('CLASS1', 'CLASSI', 'I', '1', 'CLASS2', 'CLASSII', 'II', '2') then 0
          when tok in ('CLASS3', 'CLASSIII', 'III', '3', 'VOLUNTARYRECALL') then 1 end as target
          from md_events e join tokens k on k.id = e.id) x where target is not null) t where rn <= 3""",
}
