"""Derive the 13 features of whole batches of assessment requests from history.

Each feature is a cascade of rungs; the first that hits gives the value and its source. A
rung is ``struct(value, source)`` or NULL, a cascade is ``coalesce`` over its rungs. All
rungs come from aggregates keyed by the distinct terms of the requests
(manufacturer term, device term, class term), never from per-request lookups.
"""

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.functions.cleaning import clean_text, map_implant_status, round_half, to_numeric
from incidentlens.operators.aggregates import top_value_by_group
from incidentlens.operators.matching import first_per_term, pattern_join, pattern_matches, search_terms
from incidentlens.plans.materialize import materialize


def request_asks(requests: DataFrame) -> DataFrame:
    """What each request states, cleaned: blank means absent."""
    def stated(c, ignore=None):
        if c not in requests.columns:
            return F.lit(None).cast("string")
        text = clean_text(F.col(c).cast("string"))
        keep = text != ""
        if ignore:
            keep = keep & (F.lower(text) != ignore)
        return F.when(keep, text)

    def number(c, kind):
        if c not in requests.columns:
            return F.lit(None).cast(kind)
        return to_numeric(F.col(c)) if kind == "double" else F.col(c).try_cast(kind)

    maker = clean_text(F.col("name_manufacturer"))
    implant = clean_text(F.col("implanted"))
    return requests.select(
        "request_id",
        *(["user_id"] if "user_id" in requests.columns else []),
        implant.alias("implant_text"),
        map_implant_status(F.col("implanted")).alias("implanted"),
        maker.alias("name_manufacturer"),
        F.lower(maker).alias("mterm"),
        F.lower(F.coalesce(stated("name_device"), F.lit(""))).alias("dterm"),
        *[stated(c).alias(f"u_{c}") for c in ("type", "status", "risk_class")],
        stated("classification", "none").alias("u_classification"),
        *[F.upper(stated(c, "none")).alias(f"u_{c}") for c in ("country_event", "country_device")],
        number("quantity_in_commerce", "double").alias("u_quantity"),
        *[number(c, "int").alias(f"u_{c}")
          for c in ("event_count", "manufacturer_event_count", "event_year", "event_month")],
    )


def lookup_asks(queries: DataFrame) -> DataFrame:
    """The same shape for (query_id, manufacturer, classification, risk_class) lookups, texts taken as given."""
    def stated(c):
        return F.when(F.col(c) != "", F.col(c))

    return queries.select(
        F.col("query_id").alias("request_id"),
        F.lower(F.coalesce("manufacturer", F.lit(""))).alias("mterm"),
        stated("classification").alias("u_classification"),
        stated("risk_class").alias("u_risk_class"),
        F.lit(None).cast("string").alias("u_type"),
    )


def rung(hit, value, source):
    return F.when(hit, F.struct(value.alias("value"), F.lit(source).alias("source")))


def text_rung(value, source):
    """Hits on non-empty text."""
    return rung(F.coalesce(value, F.lit("")) != "", value, source)


def always(value, source):
    return F.struct(value.alias("value"), F.lit(source).alias("source"))


def wide_tops(counts, key, prefix):
    """One row per key: its most frequent event type and status, from ready counts ``n``."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("type", "status")])
    long = counts.select(key, "n", F.explode(cells).alias("c")).select(key, "n", "c.field", "c.value")
    top = top_value_by_group(long, [key, "field"], "value", weight="n")
    return top.groupBy(key).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"{prefix}{f}") for f in ("type", "status")])


class History:
    """Pre-aggregates shared by the cascades; each is built on first use."""

    def __init__(self, asks: DataFrame, manufacturers: DataFrame, devices: DataFrame, events: DataFrame):
        self.asks = asks
        self.manufacturers = manufacturers
        wanted = {"id", "manufacturer_id", "name", "classification", "risk_class", "country", "quantity_in_commerce"}
        self.devices = devices.select(*sorted(wanted))
        self.events = events

    def prepare(self, *names: str) -> None:
        """Build parts that don't need each other side by side: each is a few small jobs."""
        with ThreadPoolExecutor(len(names)) as pool:
            list(pool.map(lambda name: getattr(self, name), names))

    # --- events, reduced once -------------------------------------------------------

    @cached_property
    def _events_once(self):
        """The only pass over events: the cube, and the years and months seen on the way."""
        year, month = F.col("event_year"), F.col("event_month")
        usable = year.between(fv.YEAR_MIN, fv.YEAR_MAX)
        in_year = usable & month.between(fv.MONTH_MIN, fv.MONTH_MAX)
        seen = Observation()
        events = self.events.observe(
            seen,
            F.max(F.when(usable, year)).alias("latest_year"),
            # At most twelve entries per year of the fixed range.
            F.collect_set(F.when(in_year, year * 100 + month)).alias("months"),
        )
        cube = materialize(
            events.groupBy("device_id", "type", "status").agg(
                F.count("*").alias("n"),
                F.min(F.when(F.col("country") != "", F.upper("country"))).alias("country"),
            ))
        return cube, seen.get

    @property
    def cube(self) -> DataFrame:
        """Event counts per device, type and status."""
        return self._events_once[0]

    @cached_property
    def device_cube(self) -> DataFrame:
        """The cube with the owner and class of each known device."""
        owner = self.devices.select(F.col("id").alias("device_id"), "manufacturer_id", "classification")
        return self.cube.select("device_id", "type", "status", "n").join(owner, "device_id")

    # --- matched manufacturers ------------------------------------------------------

    @cached_property
    def maker_hits(self) -> DataFrame:
        """(mterm, manufacturer_id, name): at most 50 manufacturers per term."""
        terms = search_terms((self.asks, "mterm"))
        hits = pattern_join(terms, self.manufacturers, fv.MANUFACTURER_CAP)
        return materialize(hits.select(
            F.col("term").alias("mterm"), F.col("id").alias("manufacturer_id"), "name"))

    def maker_tops(self, *fields) -> DataFrame:
        """One row per term: the most frequent value of each field over the matched manufacturers' devices."""
        def counted(df, n, names):
            cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in names])
            return df.select("manufacturer_id", n.alias("n"), F.explode(cells).alias("c")).select(
                "manufacturer_id", "c.field", "c.value", "n")

        parts = []
        of_devices = [f for f in fields if f in ("classification", "risk_class")]
        of_events = [f for f in fields if f in ("type", "status")]
        if of_devices:
            parts.append(counted(self.devices, F.lit(1).cast("bigint"), of_devices))
        if of_events:
            parts.append(counted(self.device_cube, F.col("n"), of_events))
        counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        counts = counts.filter("value is not null").groupBy("manufacturer_id", "field", "value").agg(
            F.sum("n").alias("n"))
        hits = self.maker_hits.select("mterm", "manufacturer_id").join(counts, "manufacturer_id")
        top = top_value_by_group(hits, ["mterm", "field"], "value", weight="n")
        return top.groupBy("mterm").agg(
            *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"m_{f}") for f in fields])

    @cached_property
    def maker_stock(self) -> DataFrame:
        """One row per matched term: devices, quantities and a country of the matched manufacturers."""
        q = F.when(F.col("quantity_in_commerce") > 0, F.col("quantity_in_commerce"))
        per_maker = self.devices.groupBy("manufacturer_id").agg(
            F.count("*").alias("devices"), F.sum(q).alias("qsum"), F.count(q).alias("qn"),
            F.min(F.when(F.col("country") != "", F.upper("country"))).alias("country"))
        return (
            self.maker_hits.join(per_maker, "manufacturer_id", "left")
            .groupBy("mterm")
            .agg(
                F.coalesce(F.sum("devices"), F.lit(0)).alias("m_devices"),
                round_half(F.sum("qsum") / F.sum("qn"), 1).alias("m_quantity"),
                F.min("country").alias("m_country"),
                F.min_by("name", "manufacturer_id").alias("m_name"),
            )
        )

    @cached_property
    def maker_events(self) -> DataFrame:
        """Events over all devices of the matched manufacturers."""
        per_maker = self.device_cube.groupBy("manufacturer_id").agg(F.sum("n").alias("n"))
        return self.maker_hits.join(per_maker, "manufacturer_id").groupBy("mterm").agg(F.sum("n").alias("m_events"))

    # --- matched device -------------------------------------------------------------

    @cached_property
    def device_matches(self) -> DataFrame:
        """(mterm, dterm, device_id): lowest id among the matched manufacturers' devices, else among all."""
        pairs = self.asks.select("mterm", "dterm").filter("dterm != ''").distinct()
        # Equal names of one manufacturer are interchangeable but for the lowest id.
        names = self.devices.filter("name is not null").groupBy(F.lower("name").alias("name"), "manufacturer_id").agg(
            F.min("id").alias("id"))
        found = pattern_matches(search_terms((self.asks, "dterm")), names, "name", "id")
        per_maker = found.groupBy(F.col("term").alias("dterm"), "manufacturer_id").agg(F.min("id").alias("id"))
        scoped = (
            pairs.join(self.maker_hits.select("mterm", "manufacturer_id"), "mterm")
            .join(per_maker, ["dterm", "manufacturer_id"])
            .groupBy("mterm", "dterm")
            .agg(F.min("id").alias("scoped"))
        )
        anywhere = per_maker.groupBy("dterm").agg(F.min("id").alias("anywhere"))
        return (
            pairs.join(anywhere, "dterm")
            .join(scoped, ["mterm", "dterm"], "left")
            .select("mterm", "dterm", F.coalesce("scoped", "anywhere").alias("device_id"))
        )

    @cached_property
    def _matches(self):
        return materialize(self.device_matches)

    @cached_property
    def device_facts(self) -> DataFrame:
        """(mterm, dterm) -> the matched device's own columns."""
        own = self.devices.select(
            F.col("id").alias("device_id"), F.col("risk_class").alias("d_risk_class"), F.col("country").alias("d_country"),
            F.col("quantity_in_commerce").alias("d_quantity"))
        return self._matches.join(own, "device_id").drop("device_id")

    @cached_property
    def device_events(self) -> DataFrame:
        """(mterm, dterm) -> the matched device's event count and most frequent type and status."""
        ids = self._matches.select("device_id").distinct()
        own = self.cube.join(ids, "device_id", "left_semi")
        total = own.groupBy("device_id").agg(F.sum("n").alias("d_events")).join(
            wide_tops(own, "device_id", "d_"), "device_id", "left")
        return self._matches.join(total, "device_id").drop("device_id")

    # --- device classes -------------------------------------------------------------

    @cached_property
    def class_hits(self) -> DataFrame:
        """(cterm, classification): catalog classes that contain a stated or catalog class."""
        q = F.when(F.col("quantity_in_commerce") > 0, F.col("quantity_in_commerce"))
        catalog = materialize(
            self.devices.filter("classification is not null").groupBy("classification").agg(
                F.sum(q).alias("qsum"), F.count(q).alias("qn")))
        terms = search_terms((self.asks, "u_classification"), (catalog, "classification"))
        hits = pattern_matches(terms, catalog, "classification", "classification")
        return materialize(hits.withColumnRenamed("term", "cterm"))

    @cached_property
    def class_stock(self) -> DataFrame:
        """One row per class term: most frequent risk class and mean quantity."""
        counts = self.devices.filter("risk_class is not null").groupBy("classification", "risk_class").agg(
            F.count("*").alias("n"))
        top = top_value_by_group(self.class_hits.join(counts, "classification"), "cterm", "risk_class", weight="n")
        quantity = self.class_hits.groupBy("cterm").agg(
            round_half(F.sum("qsum") / F.sum("qn"), 1).alias("c_quantity"))
        return quantity.join(top.select("cterm", F.col("risk_class").alias("c_risk_class")), "cterm", "left")

    @cached_property
    def class_devices(self) -> DataFrame:
        """(cterm, device_id): the first 200 devices of each class term by id."""
        per_class = Window.partitionBy("classification").orderBy("id")
        first = (
            self.devices.filter("classification is not null").select("id", "classification")
            .withColumn("_rn", F.row_number().over(per_class))
            .filter(F.col("_rn") <= fv.CLASS_DEVICE_CAP).drop("_rn")
        )
        hits = self.class_hits.select(F.col("cterm").alias("term"), "classification").join(first, "classification")
        return first_per_term(hits, fv.CLASS_DEVICE_CAP).select(
            F.col("term").alias("cterm"), F.col("id").alias("device_id"))

    @cached_property
    def class_events(self) -> DataFrame:
        """One row per class term: events of its first 200 devices (also 0), top type and status."""
        own = self.class_devices.join(self.cube, "device_id", "left")
        total = own.groupBy("cterm").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("c_events"))
        return total.join(wide_tops(own, "cterm", "c_"), "cterm", "left")

    @cached_property
    def maker_class_events(self) -> DataFrame:
        """(mterm, cterm) -> events of the matched manufacturers' devices in the class."""
        per_maker = self.device_cube.filter("classification is not null").groupBy(
            "manufacturer_id", "classification").agg(F.sum("n").alias("n"))
        per_term = self.maker_hits.join(per_maker, "manufacturer_id").groupBy("mterm", "classification").agg(
            F.sum("n").alias("n"))
        return per_term.join(self.class_hits.select("cterm", "classification"), "classification").groupBy(
            "mterm", "cterm").agg(F.sum("n").alias("mc_events"))

    # --- global baselines -----------------------------------------------------------

    @cached_property
    def risk_class_tops(self) -> DataFrame:
        """Written, so that its true (small) size decides how it meets the requests: most of
        them state no risk class and would share one shuffle key."""
        top = top_value_by_group(self.devices.filter("risk_class is not null"), "risk_class", "classification")
        return materialize(
            top.select(F.col("risk_class").alias("u_risk_class"), F.col("classification").alias("r_classification")))

    @cached_property
    def _first_known(self) -> dict:
        def lowest(col):
            return F.min_by(col, F.when(F.col(col).isNotNull(), F.col("id"))).alias(col)

        return self.devices.agg(lowest("classification"), lowest("risk_class")).first().asDict()

    def first_known(self, col, default):
        """The value of the lowest device id that has one."""
        value = self._first_known[col]
        return F.lit(default if value is None else value)

    @cached_property
    def _global_tops(self) -> dict:
        return wide_tops(self.cube.withColumn("all", F.lit(1)), "all", "").first()

    def global_top(self, col, default):
        top = self._global_tops
        return F.lit(default if top is None or top[col] is None else top[col])

    @cached_property
    def country_by_type(self) -> DataFrame:
        types = self.cube.filter("type is not null").groupBy("type").agg(F.min("country").alias("country"))
        terms = search_terms((self.asks, "u_type"), (types, "type"))
        hits = pattern_matches(terms, types, "type", "type")
        return hits.groupBy(F.col("term").alias("tterm")).agg(F.min("country").alias("t_country"))

    # --- cascades -------------------------------------------------------------------

    def with_classification(self, r: DataFrame, tops: DataFrame) -> DataFrame:
        value = F.coalesce(
            text_rung(F.col("u_classification"), fv.SRC_USER_SELECTION),
            text_rung(F.col("m_classification"), fv.SRC_HISTORY),
            text_rung(F.col("r_classification"), fv.SRC_HISTORY),
            always(self.first_known("classification", fv.DEFAULT_CLASSIFICATION), fv.SRC_CATALOG),
        )
        return (
            r.join(tops, "mterm", "left")
            .join(self.risk_class_tops, "u_risk_class", "left")
            .withColumn("classification", value)
            .withColumn("cterm", F.lower("classification.value"))
        )

    def risk_class(self):
        return F.coalesce(
            text_rung(F.col("u_risk_class"), fv.SRC_USER_PROVIDED),
            text_rung(F.col("d_risk_class"), fv.SRC_DEVICE),
            text_rung(F.col("m_risk_class"), fv.SRC_HISTORY),
            text_rung(F.col("c_risk_class"), fv.SRC_HISTORY),
            always(self.first_known("risk_class", fv.DEFAULT_RISK_CLASS), fv.SRC_CATALOG),
        )

    def of_events(self, field, default):
        """Type and status: matched device, matched manufacturers, class, whole dataset."""
        return F.coalesce(
            text_rung(F.col(f"u_{field}"), fv.SRC_USER_PROVIDED),
            text_rung(F.col(f"d_{field}"), fv.SRC_DEVICE),
            text_rung(F.col(f"m_{field}"), fv.SRC_HISTORY),
            text_rung(F.col(f"c_{field}"), fv.SRC_HISTORY),
            always(self.global_top(field, default), fv.SRC_CATALOG),
        )

    @staticmethod
    def manufacturer_event_count():
        count = F.coalesce("m_events", F.lit(0))
        return F.coalesce(
            rung(F.col("u_manufacturer_event_count").isNotNull(),
                 F.col("u_manufacturer_event_count").cast("bigint"), fv.SRC_USER_PROVIDED),
            rung(F.col("m_devices") > 0, count, fv.SRC_HISTORY),
            always(F.lit(0).cast("bigint"), fv.SRC_NO_RECORDS),
        )

    @staticmethod
    def event_count():
        return F.coalesce(
            rung(F.col("u_event_count").isNotNull(), F.col("u_event_count").cast("bigint"), fv.SRC_USER_PROVIDED),
            rung(F.col("d_events") > 0, F.col("d_events"), fv.SRC_DEVICE),
            rung(F.col("mc_events") > 0, F.col("mc_events"), fv.SRC_HISTORY),
            rung(F.col("c_events").isNotNull(), F.col("c_events"), fv.SRC_HISTORY),
            always(F.lit(0).cast("bigint"), fv.SRC_NO_RECORDS),
        )

    @staticmethod
    def country_device():
        return F.coalesce(
            text_rung(F.col("u_country_device"), fv.SRC_USER_SELECTION),
            text_rung(F.upper("d_country"), fv.SRC_DEVICE),
            text_rung(F.col("m_country"), fv.SRC_HISTORY),
            always(F.lit(fv.DEFAULT_COUNTRY), fv.SRC_MARKET),
        )

    @staticmethod
    def country_event():
        return F.coalesce(
            text_rung(F.col("u_country_event"), fv.SRC_USER_SELECTION),
            text_rung(F.col("t_country"), fv.SRC_HISTORY),
            always(F.lit(fv.DEFAULT_COUNTRY), fv.SRC_INCIDENT),
        )

    @staticmethod
    def quantity():
        return F.coalesce(
            rung(F.col("u_quantity").isNotNull(), F.col("u_quantity"), fv.SRC_USER_PROVIDED),
            rung(F.col("d_quantity") > 0, round_half(F.col("d_quantity"), 1), fv.SRC_DEVICE),
            rung(F.col("m_quantity") > 0, F.col("m_quantity"), fv.SRC_HISTORY),
            rung(F.col("c_quantity") > 0, F.col("c_quantity"), fv.SRC_HISTORY),
            always(F.lit(fv.DEFAULT_QUANTITY), fv.SRC_VOLUME),
        )

    def event_year(self):
        latest = self._events_once[1]["latest_year"]
        return F.coalesce(
            rung(F.col("u_event_year").isNotNull(), F.col("u_event_year"), fv.SRC_USER_SELECTION),
            always(F.lit(fv.DEFAULT_YEAR if latest is None else latest), fv.SRC_EVENT_RECORD),
        )

    def event_month(self, year):
        """The highest month of the resolved ``year``."""
        latest = F.lit(fv.DEFAULT_MONTH)
        last = {code // 100: code % 100 for code in sorted(self._events_once[1]["months"])}
        if last:
            lookup = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
            latest = F.coalesce(F.try_element_at(lookup, year), latest)
        return F.coalesce(
            rung(F.col("u_event_month").isNotNull(), F.col("u_event_month"), fv.SRC_USER_SELECTION),
            always(latest, fv.SRC_EVENT_RECORD),
        )

    # --- one written row per key, for jobs that need all cascades ----------------------

    @cached_property
    def maker_profile(self) -> DataFrame:
        tops = self.maker_tops("classification", "risk_class", "type", "status")
        return materialize(
            self.maker_stock.join(self.maker_events, "mterm", "left").join(tops, "mterm", "left"))

    @cached_property
    def device_profile(self) -> DataFrame:
        return materialize(self.device_facts.join(self.device_events, ["mterm", "dterm"], "left"))

    @cached_property
    def class_profile(self) -> DataFrame:
        return materialize(self.class_stock.join(self.class_events, "cterm", "left"))


def history_for(requests: DataFrame, m: DataFrame, d: DataFrame, e: DataFrame) -> History:
    return History(request_asks(requests), m, d, e)


def _split(r, name):
    return r.select("request_id", F.col(f"{name}.value").alias("value"), F.col(f"{name}.source").alias("source"))


# Each feature alone, from only the aggregates it needs: (request_id, value, source).


def match_manufacturers(h: History) -> DataFrame:
    return h.maker_hits


def match_device(h: History) -> DataFrame:
    return h.asks.join(h.device_matches, ["mterm", "dterm"], "left").select("request_id", "device_id")


def derive_classification(h: History) -> DataFrame:
    return _split(h.with_classification(h.asks, h.maker_tops("classification")), "classification")


def derive_risk_class(h: History) -> DataFrame:
    r = (
        h.with_classification(h.asks, h.maker_tops("classification", "risk_class"))
        .join(h.device_facts, ["mterm", "dterm"], "left")
        .join(h.class_stock, "cterm", "left")
    )
    return _split(r.withColumn("risk_class", h.risk_class()), "risk_class")


def _derive_of_events(h, field, default):
    r = (
        h.with_classification(h.asks, h.maker_tops("classification", field))
        .join(h.device_events, ["mterm", "dterm"], "left")
        .join(h.class_events, "cterm", "left")
    )
    return _split(r.withColumn(field, h.of_events(field, default)), field)


def derive_type(h: History) -> DataFrame:
    return _derive_of_events(h, "type", fv.DEFAULT_TYPE)


def derive_status(h: History) -> DataFrame:
    return _derive_of_events(h, "status", fv.DEFAULT_STATUS)


def derive_manufacturer_event_count(h: History) -> DataFrame:
    r = h.asks.join(h.maker_stock, "mterm", "left").join(h.maker_events, "mterm", "left")
    return _split(r.withColumn("v", h.manufacturer_event_count()), "v")


def derive_event_count(h: History) -> DataFrame:
    r = (
        h.with_classification(h.asks, h.maker_tops("classification"))
        .join(h.device_events, ["mterm", "dterm"], "left")
        .join(h.maker_class_events, ["mterm", "cterm"], "left")
        .join(h.class_events, "cterm", "left")
    )
    return _split(r.withColumn("v", h.event_count()), "v")


def derive_country_device(h: History) -> DataFrame:
    r = h.asks.join(h.maker_stock, "mterm", "left").join(h.device_facts, ["mterm", "dterm"], "left")
    return _split(r.withColumn("v", h.country_device()), "v")


def derive_country_event(h: History) -> DataFrame:
    r = (
        h.with_classification(h.asks, h.maker_tops("classification", "type"))
        .join(h.device_events, ["mterm", "dterm"], "left")
        .join(h.class_events, "cterm", "left")
        .withColumn("tterm", F.lower(h.of_events("type", fv.DEFAULT_TYPE)["value"]))
        .join(h.country_by_type, "tterm", "left")
    )
    return _split(r.withColumn("v", h.country_event()), "v")


def derive_quantity(h: History) -> DataFrame:
    r = (
        h.with_classification(h.asks, h.maker_tops("classification"))
        .join(h.maker_stock, "mterm", "left")
        .join(h.device_facts, ["mterm", "dterm"], "left")
        .join(h.class_stock, "cterm", "left")
    )
    return _split(r.withColumn("v", h.quantity()), "v")


def derive_event_year(h: History) -> DataFrame:
    return _split(h.asks.withColumn("v", h.event_year()), "v")


def derive_event_month(h: History) -> DataFrame:
    r = h.asks.withColumn("y", h.event_year()).withColumn("v", h.event_month(F.col("y.value")))
    return _split(r, "v")


def request_errors():
    """Messages of what a request lacks or states out of bounds; derived defaults are always in bounds."""
    missing = F.array_compact(F.array(
        F.when(F.col("implant_text") == "", fv.MSG_MISSING_IMPLANT),
        F.when(F.col("name_manufacturer") == "", fv.MSG_MISSING_MANUFACTURER)))
    return F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit(fv.MSG_MISSING), F.array_join(missing, ", "))),
        F.when(F.col("u_quantity") < 0, "quantity_in_commerce" + fv.MSG_NEGATIVE),
        F.when(F.col("u_event_count") < 0, "event_count" + fv.MSG_NEGATIVE),
        F.when(F.col("u_manufacturer_event_count") < 0, "manufacturer_event_count" + fv.MSG_NEGATIVE),
        F.when(~F.col("u_event_year").between(fv.YEAR_MIN, fv.YEAR_MAX), fv.MSG_YEAR),
        F.when(~F.col("u_event_month").between(fv.MONTH_MIN, fv.MONTH_MAX), fv.MSG_MONTH),
    ))


def validate_request(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted requests, rejected requests with ``errors``)."""
    errors = request_asks(requests).select("request_id", request_errors().alias("errors"))
    checked = requests.join(errors, "request_id")
    good = F.size("errors") == 0
    return checked.filter(good).drop("errors"), checked.filter(~good)


def feature_provenance(df: DataFrame) -> DataFrame:
    """Fold 13 ``struct(value, source)`` columns into features plus ``features_used``, in feature order."""
    used = F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            F.lit(fv.PROVENANCE_LABELS[f]).alias("feature_name"),
            F.col(f"{f}.value").cast("string").alias("value"),
            F.col(f"{f}.source").alias("source"),
        )
        for f in fv.FEATURES])
    others = [c for c in df.columns if c not in fv.FEATURES]
    return df.select(*others, *[F.col(f"{f}.value").alias(f) for f in fv.FEATURES], used.alias("features_used"))


def derive_features(requests: DataFrame, m: DataFrame, d: DataFrame, e: DataFrame) -> DataFrame:
    """Every request with its 13 features, their provenance and its validation errors."""
    h = history_for(requests, m, d, e)
    h.prepare("_events_once", "maker_hits", "class_hits", "risk_class_tops", "_first_known")
    h.prepare("maker_profile", "device_profile", "class_profile", "_global_tops", "country_by_type")
    r = (
        h.with_classification(h.asks, h.maker_profile)
        .join(h.device_profile, ["mterm", "dterm"], "left")
        .join(h.class_profile, "cterm", "left")
        .join(h.maker_class_events, ["mterm", "cterm"], "left")
        .withColumn("type", h.of_events("type", fv.DEFAULT_TYPE))
        .withColumn("tterm", F.lower("type.value"))
        .join(h.country_by_type, "tterm", "left")
        .withColumns({
            "status": h.of_events("status", fv.DEFAULT_STATUS),
            "risk_class": h.risk_class(),
            "country_event": h.country_event(),
            "country_device": h.country_device(),
            "quantity_in_commerce": h.quantity(),
            "event_count": h.event_count(),
            "manufacturer_event_count": h.manufacturer_event_count(),
            "event_year": h.event_year(),
            "errors": request_errors(),
        })
        .withColumn("event_month", h.event_month(F.col("event_year.value")))
        .withColumns({
            "implanted": always(F.col("implanted"), fv.SRC_USER_SELECTION),
            "name_manufacturer": always(F.col("name_manufacturer"), fv.SRC_USER_SELECTION),
        })
    )
    keep = [c for c in ("request_id", "user_id") if c in r.columns]
    return feature_provenance(r.select(*keep, "errors", *fv.FEATURES))


def historical_counts(queries: DataFrame, m: DataFrame, d: DataFrame, e: DataFrame) -> DataFrame:
    """Per lookup: event counts, mean quantity, matched devices and name, and a note."""
    h = History(lookup_asks(queries), m, d, e)
    h.prepare("_events_once", "maker_hits", "class_hits", "risk_class_tops", "_first_known")
    r = (
        h.with_classification(h.asks, h.maker_tops("classification"))
        .join(h.maker_stock, "mterm", "left")
        .join(h.maker_events, "mterm", "left")
        .join(h.class_stock, "cterm", "left")
        .join(h.class_events, "cterm", "left")
        .join(h.maker_class_events, ["mterm", "cterm"], "left")
    )
    makers = F.coalesce("m_events", F.lit(0))
    found = F.coalesce("m_devices", F.lit(0)) > 0
    return r.select(
        F.col("request_id").alias("query_id"),
        F.when(F.col("mc_events") > 0, F.col("mc_events")).otherwise(F.coalesce("c_events", F.lit(0)))
        .alias("event_count"),
        makers.alias("manufacturer_event_count"),
        F.coalesce(*[F.when(F.col(c) > 0, F.col(c)) for c in ("m_quantity", "c_quantity")],
                   F.lit(fv.DEFAULT_QUANTITY)).alias("avg_quantity_in_commerce"),
        F.coalesce("m_devices", F.lit(0)).alias("matched_device_count"),
        F.col("m_name").alias("matched_manufacturer_name"),
        F.when(found, F.format_string(fv.NOTE_FOUND, makers, F.col("m_name"))).otherwise(fv.NOTE_NONE).alias("note"),
    )
