from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.operators import derive as ops
from incidentlens.operators.matching import pattern_join, search_terms


def _top(keys, value, source, weight="count(*)", where="true"):
    """SQL of the most frequent value per key, ties to the smaller value."""
    return f"""select {keys}, {value} from (select {keys}, {value}, row_number() over (partition by {keys}
        order by {weight} desc, {value}) as rn from {source} where {value} is not null and {where}
        group by {keys}, {value}) t where rn = 1"""


POSITIVE = "case when quantity_in_commerce > 0 then quantity_in_commerce end"
EXTRA = {
    "asks": """
        select request_id, coalesce(trim(implanted), '') as implant_text, coalesce(trim(name_manufacturer), '') as maker,
          lower(coalesce(trim(name_manufacturer), '')) as mterm, lower(coalesce(trim(name_device), '')) as dterm,
          nullif(trim(classification), '') as u_classification, event_month as u_event_month from md_requests""",
    "m_hits": """
        select mterm, manufacturer_id, name from (
          select t.mterm, m.id as manufacturer_id, m.name, row_number() over (partition by t.mterm order by m.id) as rn
          from (select distinct mterm from asks where mterm <> '') t
            join md_manufacturers m on m.name ilike '%' || t.mterm || '%') x where rn <= 50""",
    "m_devices": "select h.mterm, d.* from m_hits h join md_devices d on d.manufacturer_id = h.manufacturer_id",
    "m_events": "select x.mterm, x.classification, e.* from m_devices x join md_events e on e.device_id = x.id",
    "m_stock": f"""
        select h.mterm, count(d.id) as m_devices,
          cast(round(cast(avg({POSITIVE}) as decimal(38,8)), 1) as double) as m_quantity,
          min(case when country <> '' then upper(country) end) as m_country, min_by(h.name, h.manufacturer_id) as m_name
        from m_hits h left join md_devices d on d.manufacturer_id = h.manufacturer_id group by h.mterm""",
    "d_match": """
        select a.request_id, coalesce(
          (select min(d.id) from m_devices d where d.mterm = a.mterm and d.name ilike '%' || a.dterm || '%'),
          (select min(d.id) from md_devices d where d.name ilike '%' || a.dterm || '%')) as device_id
        from asks a where a.dterm <> '' """,
    "m_class": _top("mterm", "classification", "m_devices"),
    "m_risk": _top("mterm", "risk_class", "m_devices"),
    "m_type": _top("mterm", "type", "m_events"),
    "m_status": _top("mterm", "status", "m_events"),
    "d_type": _top("device_id", "type", "md_events"),
    "d_status": _top("device_id", "status", "md_events"),
    "d_count": "select device_id, count(*) as n from md_events group by device_id",
    "classed": """
        select a.*, coalesce(u_classification, nullif(m.classification, ''), b.classification, 'Cardiovascular Devices')
            as classification,
          case when u_classification is not null then 'User selection' when m.classification <> '' then 'Historical dataset'
            else 'Dataset catalog baseline' end as class_source,
          lower(coalesce(u_classification, nullif(m.classification, ''), b.classification, 'Cardiovascular Devices')) as cterm,
          dm.device_id, d.risk_class as d_risk, d.country as d_country, d.quantity_in_commerce as d_quantity
        from asks a left join m_class m on m.mterm = a.mterm
          left join d_match dm on dm.request_id = a.request_id left join md_devices d on d.id = dm.device_id,
          (select min_by(classification, id) as classification from md_devices where classification is not null) b""",
    "c_terms": "select distinct cterm from classed",
    "c_devices": "select t.cterm, d.* from c_terms t join md_devices d on d.classification ilike '%' || t.cterm || '%'",
    "c_first": """select cterm, id from (select cterm, id, row_number() over (partition by cterm order by id) as rn
        from c_devices) t where rn <= 200""",
    "c_events": "select f.cterm, e.* from c_first f join md_events e on e.device_id = f.id",
    "c_total": """select f.cterm, count(e.id) as n from c_first f left join md_events e on e.device_id = f.id
        group by f.cterm""",
    "c_risk": _top("cterm", "risk_class", "c_devices"),
    "c_type": _top("cterm", "type", "c_events"),
    "c_status": _top("cterm", "status", "c_events"),
    "c_quantity": f"""select cterm, cast(round(cast(avg({POSITIVE}) as decimal(38,8)), 1) as double) as c_quantity
        from c_devices group by cterm""",
    "mc_count": """select t.mterm, t.cterm, count(*) as n from (select distinct mterm, cterm from classed) t
        join m_events e on e.mterm = t.mterm and e.classification ilike '%' || t.cterm || '%'
        group by t.mterm, t.cterm""",
    "q_classification": "select request_id, classification as value, class_source as source from classed",
    "q_risk_class": """
        select c.request_id, coalesce(nullif(d_risk, ''), nullif(m.risk_class, ''), nullif(r.risk_class, ''),
            b.risk_class, '2') as value,
          case when d_risk <> '' then 'Matched device record' when m.risk_class <> '' then 'Historical dataset'
            when r.risk_class <> '' then 'Historical dataset' else 'Dataset catalog baseline' end as source
        from classed c left join m_risk m on m.mterm = c.mterm left join c_risk r on r.cterm = c.cterm,
          (select min_by(risk_class, id) as risk_class from md_devices where risk_class is not null) b""",
    "q_manufacturer_event_count": """
        select a.request_id, case when s.m_devices > 0 then coalesce(n, 0) else 0 end as value,
          case when s.m_devices > 0 then 'Historical dataset' else 'No records' end as source
        from asks a left join m_stock s on s.mterm = a.mterm
          left join (select mterm, count(*) as n from m_events group by mterm) e on e.mterm = a.mterm""",
    "q_event_count": """
        select c.request_id, coalesce(d.n, mc.n, ct.n, 0) as value,
          case when d.n > 0 then 'Matched device record' when mc.n > 0 then 'Historical dataset'
            when ct.n is not null then 'Historical dataset' else 'No records' end as source
        from classed c left join d_count d on d.device_id = c.device_id
          left join mc_count mc on mc.mterm = c.mterm and mc.cterm = c.cterm left join c_total ct on ct.cterm = c.cterm""",
    "q_country_device": """
        select c.request_id, coalesce(nullif(upper(d_country), ''), m_country, 'USA') as value,
          case when d_country <> '' then 'Matched device record' when m_country is not null then 'Historical dataset'
            else 'Dataset market baseline' end as source
        from classed c left join m_stock s on s.mterm = c.mterm""",
    "q_country_event": """
        select t.request_id, coalesce(k.country, 'USA') as value,
          case when k.country is not null then 'Historical dataset' else 'Dataset incident baseline' end as source
        from q_type t left join (
          select v.value, min(case when e.country <> '' then upper(e.country) end) as country
          from (select distinct value from q_type) v join md_events e on e.type ilike '%' || v.value || '%'
          group by v.value) k on k.value = t.value""",
    "q_quantity": """
        select c.request_id, coalesce(case when d_quantity > 0 then cast(round(cast(d_quantity as decimal(38,8)), 1) as double) end,
            m_quantity, c_quantity, 10000.0) as value,
          case when d_quantity > 0 then 'Matched device record' when m_quantity > 0 then 'Historical dataset'
            when c_quantity > 0 then 'Historical dataset' else 'Catalog volume baseline' end as source
        from classed c left join m_stock s on s.mterm = c.mterm left join c_quantity q on q.cterm = c.cterm""",
    "q_event_year": """
        select request_id, y.latest as value, 'Historical event record' as source from asks,
          (select coalesce(max(case when event_year between 1980 and 2035 then event_year end), 2025) as latest
           from md_events) y""",
    "q_event_month": """
        select a.request_id, coalesce(a.u_event_month, m.latest, 6) as value,
          case when a.u_event_month is not null then 'User selection' else 'Historical event record' end as source
        from asks a join q_event_year y on y.request_id = a.request_id left join
          (select event_year, max(event_month) as latest from md_events group by event_year) m on m.event_year = y.value""",
    "q_errors": """
        select request_id, case when implant_text = '' or maker = '' then
            'Additional information is required before this assessment can be performed: ' ||
            concat_ws(', ', case when implant_text = '' then 'Implant Status (implanted)' end,
              case when maker = '' then 'Manufacturer (name_manufacturer)' end) end as missing,
          case when u_event_month not between 1 and 12 then 'event_month must be between 1 and 12.' end as month
        from asks""",
}
for _field in ("type", "status"):
    EXTRA[f"q_{_field}"] = f"""
        select c.request_id, coalesce(nullif(d.{_field}, ''), nullif(m.{_field}, ''), nullif(k.{_field}, ''), b.{_field}) as value,
          case when d.{_field} <> '' then 'Matched device record' when m.{_field} <> '' then 'Historical dataset'
            when k.{_field} <> '' then 'Historical dataset' else 'Dataset catalog baseline' end as source
        from classed c left join d_{_field} d on d.device_id = c.device_id left join m_{_field} m on m.mterm = c.mterm
          left join c_{_field} k on k.cterm = c.cterm,
          (select {_field} from md_events where {_field} is not null group by {_field}
           order by count(*) desc, {_field} limit 1) b"""

# The 13 values of a request, in feature order.
VALUE_OF = {
    "type": "q_type", "status": "q_status", "classification": "q_classification", "risk_class": "q_risk_class",
    "country_event": "q_country_event", "country_device": "q_country_device", "quantity_in_commerce": "q_quantity",
    "event_count": "q_event_count", "manufacturer_event_count": "q_manufacturer_event_count",
    "event_year": "q_event_year", "event_month": "q_event_month",
}
EXTRA["q_implanted"] = """
    select request_id, case when upper(implant_text) like '%YES%' or upper(implant_text) like '%IMPLANTED%' then 'YES'
      else 'NO' end as value, 'User selection' as source from asks"""
EXTRA["q_maker"] = "select request_id, maker as value, 'User selection' as source from asks"
VALUE_OF["implanted"] = "q_implanted"
VALUE_OF["name_manufacturer"] = "q_maker"


def _history(t):
    return ops.history_for(t.requests, t.manufacturers, t.devices, t.events)


def _features(t):
    return ops.derive_features(t.requests, t.manufacturers, t.devices, t.events)


def _provenance(t):
    return _features(t).select("request_id", F.posexplode("features_used").alias("position", "f")).select(
        "request_id", "position", "f.*")


def _pattern_join(t):
    """Each distinct requested device name as a term over all devices."""
    return pattern_join(search_terms((t.requests, "name_device")), t.devices, fv.CLASS_DEVICE_CAP)


def _lookups(t):
    """A lookup per request: the same texts, with a risk class for those without a known maker."""
    r = t.requests
    return r.select(
        F.col("request_id").alias("query_id"), F.col("name_manufacturer").alias("manufacturer"), "classification",
        F.when(F.col("name_manufacturer").isNull() | (F.col("name_manufacturer") == "no such maker"), "3")
        .alias("risk_class"))


def _rejected(t):
    return ops.validate_request(t.requests)[1].select("request_id", F.explode("errors").alias("error"))


def _single(name):
    return lambda t: getattr(ops, name)(_history(t))


SINGLES = ["classification", "risk_class", "type", "status", "manufacturer_event_count", "event_count",
           "country_device", "country_event", "quantity", "event_year", "event_month"]

QUERIES = {
    "pattern_join": _pattern_join,
    "match_manufacturers": _single("match_manufacturers"),
    "match_device": _single("match_device"),
    **{f"derive_{s}": _single(f"derive_{s}") for s in SINGLES},
    "validate_request": _rejected,
    "derive_features": lambda t: _features(t).select("request_id", *fv.FEATURES, F.size("errors").alias("n_errors")),
    "feature_provenance": _provenance,
    "historical_counts": lambda t: ops.historical_counts(_lookups(t), t.manufacturers, t.devices, t.events),
}

ORACLE = {
    "pattern_join": """select term, id, name from (select t.term, d.id, d.name,
        row_number() over (partition by t.term order by d.id) as rn
        from (select distinct lower(name_device) as term from md_requests where name_device <> '') t
          join md_devices d on d.name ilike '%' || t.term || '%') x where rn <= 200""",
    "match_manufacturers": "select mterm, manufacturer_id, name from m_hits",
    "match_device": "select a.request_id, d.device_id from asks a left join d_match d on d.request_id = a.request_id",
    **{f"derive_{s}": f"select request_id, value, source from q_{s}" for s in SINGLES},
    "validate_request": """select request_id, missing as error from q_errors where missing is not null
        union all select request_id, month from q_errors where month is not null""",
    "derive_features": "select a.request_id, "
        + ", ".join(f"{q}.value as {f}" for f, q in VALUE_OF.items())
        + """, (missing is not null)::int + (month is not null)::int as n_errors from asks a
          join q_errors on q_errors.request_id = a.request_id """
        + " ".join(f"join {q} on {q}.request_id = a.request_id" for q in VALUE_OF.values()),
    "feature_provenance": " union all ".join(
        f"""select request_id, {fv.FEATURES.index(f)} as position, '{f}' as feature, '{fv.PROVENANCE_LABELS[f]}' as feature_name,
        cast(value as string) as value, source from {q}""" for f, q in VALUE_OF.items()),
    "historical_counts": """
        with lk as (select request_id as query_id, lower(coalesce(name_manufacturer, '')) as mterm,
            nullif(classification, '') as cls,
            case when name_manufacturer is null or name_manufacturer = 'no such maker' then '3' end as rc from md_requests),
          rtop as (select risk_class, classification from (select risk_class, classification, row_number() over
            (partition by risk_class order by count(*) desc, classification) as rn from md_devices
            where risk_class is not null and classification is not null group by risk_class, classification) t where rn = 1),
          base as (select min_by(classification, id) as classification from md_devices where classification is not null),
          r as (select lk.*, coalesce(cls, nullif(m.classification, ''), nullif(rtop.classification, ''), base.classification)
              as classification from lk left join m_class m on m.mterm = lk.mterm
              left join rtop on rtop.risk_class = lk.rc, base),
          mc as (select t.mterm, t.classification, count(*) as n from (select distinct mterm, classification from r) t
            join m_events e on e.mterm = t.mterm and e.classification ilike '%' || t.classification || '%' group by all),
          cd as (select t.classification as cterm, d.id, d.quantity_in_commerce,
              row_number() over (partition by t.classification order by d.id) as rn
            from (select distinct classification from r) t
            join md_devices d on d.classification ilike '%' || t.classification || '%'),
          cn as (select cterm, count(e.id) as n from cd left join md_events e on e.device_id = cd.id where rn <= 200
            group by cterm),
          cq as (select cterm, cast(round(cast(avg(case when quantity_in_commerce > 0 then quantity_in_commerce end)
            as decimal(38,8)), 1) as double) as q from cd group by cterm),
          me as (select mterm, count(*) as n from m_events group by mterm)
        select r.query_id, coalesce(mc.n, cn.n, 0) as event_count, coalesce(me.n, 0) as manufacturer_event_count,
          coalesce(s.m_quantity, cq.q, 10000.0) as avg_quantity_in_commerce,
          coalesce(s.m_devices, 0) as matched_device_count, s.m_name as matched_manufacturer_name,
          case when s.m_devices > 0 then 'Found ' || coalesce(me.n, 0) || ' historical events for ''' || s.m_name || '''.'
            else 'No matching historical records found for the selection.' end as note
        from r left join mc on mc.mterm = r.mterm and mc.classification = r.classification
          left join cn on cn.cterm = r.classification left join cq on cq.cterm = r.classification
          left join m_stock s on s.mterm = r.mterm left join me on me.mterm = r.mterm""",
}
