"""Shared parts of the registered queries: the SQL form of the incident tables and the CTE prefix."""

import re

VIEWS = {
    "md_manufacturers": """
        select cast(s_suppkey as string) as id, s_name as name, n_name as parent_company
        from supplier join nation on s_nationkey = n_nationkey""",
    "md_devices": """
        select cast(p_partkey as string) as id, cast(s_suppkey as string) as manufacturer_id, p_name as name,
          case when p_partkey % 17 = 0 then null else p_type end as classification,
          case when p_size % 7 = 0 then null when p_size % 2 = 0 then 'YES' else 'NO' end as implanted,
          case when p_partkey % 11 = 0 then null when p_partkey % 13 = 0 then 0.0 else p_retailprice end
            as quantity_in_commerce,
          case p_size % 5 when 0 then '1' when 1 then '2' when 2 then '3' when 3 then 'II' else null end as risk_class,
          n_name as country
        from part join supplier on s_suppkey = p_partkey % (select count(*) from supplier)
          join nation on s_nationkey = n_nationkey""",
    "md_events_raw": """
        select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as id,
          cast(case when l_linenumber = 7 then l_partkey + 100000000 else l_partkey end as string) as device_id,
          case l_returnflag when 'R' then 'Recall' when 'A' then 'Safety alert' else 'Field Safety Notice' end as type,
          case o_orderstatus when 'F' then 'Completed' when 'O' then 'Open, Classified' else 'Terminated' end as status,
          n_name as country,
          case o_orderpriority when '1-URGENT' then 'Class III' when '2-HIGH' then ' class ii'
            when '3-MEDIUM' then 'Class-1' when '5-LOW' then 'Voluntary Recall' else null end as action_classification,
          case when l_linenumber = 5 and l_quantity < 10 then 'unknown'
            else cast(cast(l_shipdate as date) as string) end as date,
          l_suppkey as k1, l_quantity as k2, l_extendedprice as k3, l_partkey as k4
        from lineitem join orders on l_orderkey = o_orderkey
          join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "md_events": """
        select id, device_id, type, status, country, action_classification, date,
          cast(year(try_cast(date as date)) as int) as event_year,
          cast(month(try_cast(date as date)) as int) as event_month
        from (select *, row_number() over (partition by id order by k1, k2, k3, k4) as rn from md_events_raw) t
        where rn = 1""",
    "md_users": """
        select c_custkey as id, c_name as full_name, concat(lower(c_name), '@example.org') as email,
          case when c_custkey = 0 then 'ADMIN' when c_mktsegment in ('MACHINERY', 'BUILDING') then 'MAINTENANCE_TEAM'
            else 'BIOMEDICAL_ENGINEER' end as role,
          c_acctbal >= 0 as is_active, o.created_at
        from customer left join (select o_custkey, min(o_orderdate) as created_at from orders group by o_custkey) o
          on o_custkey = c_custkey""",
    "md_predictions": """
        select o_orderkey as id, o_custkey as user_id, s_name as name_manufacturer, p_type as classification,
          case o_orderstatus when 'F' then 'Recall' when 'O' then 'Safety alert' else 'Field Safety Notice' end as type,
          cast(p_size % 3 + 1 as string) as risk_class, (o_totalprice % 1000) / 1000.0 as risk_score,
          case when (o_totalprice % 1000) / 1000.0 >= 0.5 then 1 else 0 end as prediction,
          case when (o_totalprice % 1000) / 1000.0 >= 0.5 then 'HIGH' else 'LOW' end as risk_level,
          case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end as label, o_orderdate as created_at
        from orders join supplier on s_suppkey = o_orderkey % (select count(*) from supplier)
          join part on p_partkey = o_orderkey % (select count(*) from part)""",
    "md_audit_logs": """
        select event_id as id,
          case when event_id % 10 = 0 then null when event_id % 10 = 1 then user_id + 100000000 else user_id end as user_id,
          upper(event_type) as action, props as description, cast(null as string) as ip_address, ts as created_at
        from events""",
    "md_requests": """
        select p_partkey as request_id,
          case when p_partkey % 19 = 0 then null when p_size % 2 = 0 then 'Yes' else 'No' end as implanted,
          case when p_partkey % 23 = 0 then null when p_partkey % 29 = 0 then 'no such maker' else s_name end
            as name_manufacturer,
          case when p_partkey % 3 = 0 then p_name else null end as name_device,
          cast(null as string) as type, cast(null as string) as status, cast(null as string) as risk_class,
          case when p_partkey % 2 = 0 then p_type else null end as classification,
          cast(null as string) as country_event, cast(null as string) as country_device,
          cast(null as double) as quantity_in_commerce, cast(null as int) as event_count,
          cast(null as int) as manufacturer_event_count, cast(null as int) as event_year,
          case when p_partkey % 31 = 0 then 15 else cast(null as int) end as event_month
        from part join supplier on s_suppkey = p_partkey % (select count(*) from supplier)
        where p_partkey % 10 < 3""",
    "md_scored": """
        select id, label, prediction, risk_score as probability from md_predictions""",
}


def full_sql(body: str, extra: dict | None = None) -> str:
    """Prefix a query with the incident views (and ``extra`` named parts) it uses."""
    parts = {**VIEWS, **(extra or {})}
    body = body.strip()
    ordered = []

    def need(text):
        for name, sql in parts.items():
            if name not in ordered and sql is not text and re.search(rf"\b{name}\b", text):
                need(sql)
                ordered.append(name)

    need(body)
    ctes = [f"{n} as ({parts[n].strip()})" for n in ordered]
    if not ctes:
        return body
    prefix = "with " + ",\n".join(ctes)
    if body.lower().startswith("with "):
        return prefix + ",\n" + body[5:]
    return prefix + "\n" + body
