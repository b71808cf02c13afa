import uuid

from pyspark.sql import functions as F

from incidentlens.operators import profile as ops
from incidentlens.operators import stored_profile
from incidentlens.plans.materialize import shared_dir

COLUMNS = ["id", "device_id", "type", "status", "country", "action_classification", "date", "event_year", "event_month"]


def _distinct(t):
    """Flat form: the listed values joined by a bar."""
    p = ops.profile_distinct(t.events)
    return p.select("column", "distinct_values", F.array_join("first_values", "|").alias("first_values"))


LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def _schema(t):
    """Names and types, each with the missing values of its column."""
    df = t.raw("lineitem")
    return ops.profile_schema(df).join(ops.profile_missing(df), "column")


PART = ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']


def _stored(t):
    """Profile the part files into a new store, then again (nothing is new), and merge what is stored."""
    store, path = f"{shared_dir(t.spark)}/incidentlens-profile-{uuid.uuid4().hex}", f"{t.folder}/part.parquet"
    for _ in range(2):
        stored_profile.update_profile(t.spark, path, store)
    merged = stored_profile.merged_profile(t.spark, path, store)
    return merged.select("column", "rows", "missing", "percent", F.when(F.col("exact"), F.col("distinct_values")).alias("few_values"),
                         F.array_join("first_values", "|").alias("first_values"))


QUERIES = {
    "stored_profile": _stored,
    "profile_schema": _schema,
    "profile_shape": lambda t: ops.profile_shape(t.events),
    "profile_file_sizes": lambda t: ops.file_sizes(t.raw("lineitem")),
    "profile_missing": lambda t: ops.profile_missing(t.events),
    "profile_sample": lambda t: ops.profile_sample(t.events, "id"),
    "profile_distinct": _distinct,
}

ORACLE = {
    "stored_profile": " union all ".join(
        f"""select '{c}' as "column", count(*) as rows, count(*) filter ({c} is null) as missing,
        cast(round(cast(count(*) filter ({c} is null) * 100 / count(*) as decimal(38,8)), 1) as double) as percent,
        case when count(distinct {c}) < 50 then count(distinct {c}) end as few_values,
        case when count(distinct {c}) < 50 then (select string_agg(v, '|' order by v) from (select distinct
          cast({c} as string) as v from part where {c} is not null order by v limit 10) x) end as first_values
        from part""" for c in PART),
    "profile_schema": " union all ".join(
        f"""select {i} as position, '{c}' as "column", '{kind}' as type, count(*) filter ({c} is null) as missing,
        cast(round(cast(count(*) filter ({c} is null) * 100 / count(*) as decimal(38,8)), 1) as double) as percent
        from lineitem""" for i, (c, kind) in enumerate(LINEITEM.items())),
    "profile_shape": "select count(*) as rows, 9 as columns from md_events",
    "profile_missing": " union all ".join(
        f"""select '{c}' as "column", count(*) filter ({c} is null) as missing,
        cast(round(cast(count(*) filter ({c} is null) * 100 / count(*) as decimal(38,8)), 1) as double) as percent
        from md_events""" for c in COLUMNS),
    "profile_sample": "select * from md_events order by id limit 2",
    "profile_distinct": " union all ".join(
        f"""select '{c}' as "column", count(distinct {c}) as distinct_values, case when count(distinct {c}) < 50 then
        (select string_agg(v, '|' order by v) from (select distinct cast({c} as string) as v from md_events
          where {c} is not null order by v limit 10) x) end as first_values from md_events""" for c in COLUMNS),
}
