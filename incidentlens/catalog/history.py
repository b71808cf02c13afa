import uuid

from pyspark.sql import functions as F

from incidentlens.operators import history as ops
from incidentlens.plans import maintained
from incidentlens.plans.materialize import materialize, shared_dir

YEARLY = """
    select device_id, event_year as year, count(*) as event_count from md_events
    where event_year between 1980 and 2035 and device_id is not null group by device_id, event_year"""

TREND = """
    select s.device_id, s.n, s.total, s.years_observed, s.early / s.mid as early_avg,
      case when s.n >= 2 then ((s.total - s.early) / (s.n - s.mid) - s.early / s.mid)
        / greatest(s.early / s.mid, 1.0) end as ratio
    from (
      select y.device_id, b.n, b.mid, cast(sum(event_count) as double) as total, count(*) as years_observed,
        cast(sum(case when y.year < b.lo + b.mid then event_count else 0 end) as double) as early
      from yearly y join (
        select device_id, min(year) as lo, max(year) - min(year) + 1 as n,
          greatest(1, (max(year) - min(year) + 1) // 2) as mid
        from yearly group by device_id) b on y.device_id = b.device_id
      group by y.device_id, b.n, b.mid) s"""

LABELS = """
    select *, case when ratio is null or ratio <= 0.15 then 'Stable' when ratio <= 0.75 then 'Increasing'
        else 'Rapidly Increasing' end as trend from trend_numbers"""

TEXTS = """
    select device_id, trend,
      case trend when 'Stable' then 'stable' when 'Increasing' then 'up' else 'up_rapid' end as trend_direction,
      case when n < 2 then 'Only limited historical event data is available for this device; insufficient history to establish a clear trend.'
        when trend = 'Stable' then 'Historical event activity has remained relatively consistent.'
        when trend = 'Increasing' then 'Historical event activity shows a gradual upward trend.'
        else 'Historical event activity has increased significantly in recent years.' end as explanation,
      cast(round(cast(ratio as decimal(38,8)), 3) as double) as growth_ratio,
      cast(total as bigint) as dated_events, cast(years_observed as bigint) as years_observed
    from trend_labels"""

FILLED = """
    select g.device_id, cast(g.year as int) as year, coalesce(y.event_count, 0) as event_count
    from (select device_id, unnest(generate_series(min(year), max(year))) as year from yearly group by device_id) g
    left join yearly y on y.device_id = g.device_id and y.year = g.year"""

EXTRA = {"yearly": YEARLY, "trend_numbers": TREND, "trend_labels": LABELS, "trend_texts": TEXTS, "filled": FILLED}


def _maintained(t):
    """The cube after four batches: most events, some of them a year late; corrections; the rest and some that are no
    events; and those taken back. One batch is sent twice."""
    path = f"{shared_dir(t.spark)}/incidentlens-cube-{uuid.uuid4().hex}"
    events = materialize(t.events.select("id", *maintained.CUBE))
    part = F.pmod(F.xxhash64("id"), F.lit(10))
    late = lambda df: df.withColumn("event_year", F.col("event_year") + 1)
    wrong, rest = events.filter(part < 2), events.filter(part >= 8)
    maintained.apply_batch(t.spark, path, "first", late(wrong).unionByName(events.filter((part >= 2) & (part < 8))))
    for _ in range(2):
        maintained.apply_batch(t.spark, path, "corrections", now=wrong, before=late(wrong))
    maintained.apply_batch(t.spark, path, "rest", now=rest.unionByName(late(rest)))
    maintained.apply_batch(t.spark, path, "taken back", before=late(rest))
    return maintained.cube_rows(t.spark, path)


def report_points(t):
    """The report as flat rows: one per history point, one with NULL year for a device without any."""
    r = ops.device_history_report(t.devices, t.events)
    return r.select(
        "device_id", "device_name", F.explode_outer("history").alias("p"), "trend", "trend_direction", "explanation",
        "total_events", "years_observed", "growth_ratio",
    ).select(
        "device_id", "device_name", F.col("p.year").alias("year"), F.col("p.event_count").alias("event_count"),
        "trend", "trend_direction", "explanation", "total_events", "years_observed", "growth_ratio")


QUERIES = {
    "maintained_yearly_history": lambda t: maintained.yearly_history_of(_maintained(t)),
    "maintained_manufacturer_counts": lambda t: maintained.manufacturer_counts_of(_maintained(t), t.devices),
    "maintained_totals": lambda t: maintained.totals_of(_maintained(t)),
    "device_yearly_history": lambda t: ops.device_yearly_history(t.events),
    "zero_fill_years": lambda t: ops.zero_fill_years(ops.device_yearly_history(t.events)),
    "device_trend": lambda t: ops.device_trend(ops.device_yearly_history(t.events)).drop("history"),
    "device_history_report": report_points,
    "chart_axis_max": lambda t: ops.chart_axis_max(ops.device_yearly_history(t.events)),
}

ORACLE = {
    "maintained_yearly_history": YEARLY,
    "maintained_manufacturer_counts": """select manufacturer_id, count(*) as manufacturer_event_count
        from md_events e join md_devices d on d.id = e.device_id where manufacturer_id is not null group by manufacturer_id""",
    "maintained_totals": """select count(*) as total_events, count(*) filter (type = 'Recall') as recalls,
        count(*) filter (type = 'Safety alert') as safety_alerts, count(*) filter (type = 'Field Safety Notice') as safety_notices,
        count(distinct device_id) as devices,
        coalesce(max(case when event_year between 1980 and 2035 then event_year end), 2025) as latest_year from md_events""",
    "device_yearly_history": "select * from yearly",
    "zero_fill_years": "select * from filled",
    "device_trend": "select * from trend_texts",
    "device_history_report": """
        with counts as (select device_id, count(*) as n from md_events group by device_id)
        select d.id as device_id, coalesce(nullif(d.name, ''), 'Unknown Device') as device_name, f.year, f.event_count,
          x.trend, x.trend_direction,
          case when x.device_id is not null then x.explanation
            when coalesce(c.n, 0) = 0 then 'No historical event data available for this device.'
            else 'This device has ' || c.n || ' recorded historical event(s), but none include a usable event year, so a yearly trend cannot be displayed.' end as explanation,
          coalesce(x.dated_events, c.n, 0) as total_events, coalesce(x.years_observed, 0) as years_observed,
          x.growth_ratio
        from md_devices d left join trend_texts x on x.device_id = d.id left join counts c on c.device_id = d.id
          left join filled f on f.device_id = d.id""",
    "chart_axis_max": "select device_id, greatest(max(event_count), 1) as axis_max from yearly group by device_id",
}
