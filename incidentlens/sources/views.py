"""Map the driver's star-schema tables onto the incident tables (see FIXTURES.md, part 3)."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class IncidentTables:
    """Lazy incident tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._raw, self._sizes = {}, {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    def _size(self, name: str):
        """Row count from the file footers."""
        if name not in self._sizes:
            self._sizes[name] = self.raw(name).count()
        return F.lit(self._sizes[name])

    @cached_property
    def manufacturers(self) -> DataFrame:
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"),
                    F.col("n_name").alias("parent_company"))
        )

    @cached_property
    def devices(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        return (
            self.raw("part")
            .withColumn("maker", key % self._size("supplier"))
            .join(self.raw("supplier"), F.col("s_suppkey") == F.col("maker"))
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                key.cast("string").alias("id"),
                F.col("s_suppkey").cast("string").alias("manufacturer_id"),
                F.col("p_name").alias("name"),
                F.when(key % 17 != 0, F.col("p_type")).alias("classification"),
                F.when(size % 7 == 0, None).when(size % 2 == 0, "YES").otherwise("NO").alias("implanted"),
                F.when(key % 11 == 0, None).when(key % 13 == 0, 0.0).otherwise(F.col("p_retailprice"))
                .alias("quantity_in_commerce"),
                F.when(size % 5 == 0, "1").when(size % 5 == 1, "2").when(size % 5 == 2, "3")
                .when(size % 5 == 3, "II").alias("risk_class"),
                F.col("n_name").alias("country"),
            )
        )

    @cached_property
    def events_raw(self) -> DataFrame:
        """All event rows with duplicates; ``k1..k4`` order the copies of one id."""
        return self._events_from(self.raw("lineitem"))

    @cached_property
    def events(self) -> DataFrame:
        """One row per id. Copies share their order, so they are dropped before the joins."""
        copies = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
            "l_suppkey", "l_quantity", "l_extendedprice", "l_partkey")
        first = (
            self.raw("lineitem").repartition("l_orderkey")  # serves the join with the orders, too
            .select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_partkey",
                    "l_returnflag", "l_shipdate")
            .withColumn("rn", F.row_number().over(copies))
            .filter("rn = 1")
        )
        day = F.col("date").try_cast("date")
        return self._events_from(first).drop("k1", "k2", "k3", "k4").withColumns(
            {"event_year": F.year(day), "event_month": F.month(day)})

    def _events_from(self, lineitem: DataFrame) -> DataFrame:
        line = F.col("l_linenumber")
        # Orders meet their customers first: there are fewer of them than lines.
        orders = (
            self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")))
        return (
            lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), line.cast("string")).alias("id"),
                F.when(line == 7, F.col("l_partkey") + 100000000).otherwise(F.col("l_partkey"))
                .cast("string").alias("device_id"),
                F.when(F.col("l_returnflag") == "R", "Recall").when(F.col("l_returnflag") == "A", "Safety alert")
                .otherwise("Field Safety Notice").alias("type"),
                F.when(F.col("o_orderstatus") == "F", "Completed")
                .when(F.col("o_orderstatus") == "O", "Open, Classified").otherwise("Terminated").alias("status"),
                F.col("n_name").alias("country"),
                F.when(F.col("o_orderpriority") == "1-URGENT", "Class III")
                .when(F.col("o_orderpriority") == "2-HIGH", " class ii")
                .when(F.col("o_orderpriority") == "3-MEDIUM", "Class-1")
                .when(F.col("o_orderpriority") == "5-LOW", "Voluntary Recall").alias("action_classification"),
                F.when((line == 5) & (F.col("l_quantity") < 10), "unknown")
                .otherwise(F.col("l_shipdate").cast("date").cast("string")).alias("date"),
                F.col("l_suppkey").alias("k1"), F.col("l_quantity").alias("k2"),
                F.col("l_extendedprice").alias("k3"), F.col("l_partkey").alias("k4"),
            )
        )

    @cached_property
    def users(self) -> DataFrame:
        since = self.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"))
        return (
            self.raw("customer")
            .join(since, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select(
                F.col("c_custkey").alias("id"),
                F.col("c_name").alias("full_name"),
                F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
                F.when(F.col("c_custkey") == 0, "ADMIN")
                .when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), "MAINTENANCE_TEAM")
                .otherwise("BIOMEDICAL_ENGINEER").alias("role"),
                (F.col("c_acctbal") >= 0).alias("is_active"),
                "created_at",
            )
        )

    @cached_property
    def predictions(self) -> DataFrame:
        score = F.col("o_totalprice") % 1000 / 1000.0
        return (
            self.raw("orders")
            .withColumns({"maker": F.col("o_orderkey") % self._size("supplier"),
                          "item": F.col("o_orderkey") % self._size("part")})
            .join(self.raw("supplier"), F.col("s_suppkey") == F.col("maker"))
            .join(self.raw("part"), F.col("p_partkey") == F.col("item"))
            .select(
                F.col("o_orderkey").alias("id"),
                F.col("o_custkey").alias("user_id"),
                F.col("s_name").alias("name_manufacturer"),
                F.col("p_type").alias("classification"),
                F.when(F.col("o_orderstatus") == "F", "Recall").when(F.col("o_orderstatus") == "O", "Safety alert")
                .otherwise("Field Safety Notice").alias("type"),
                (F.col("p_size") % 3 + 1).cast("string").alias("risk_class"),
                score.alias("risk_score"),
                F.when(score >= 0.5, 1).otherwise(0).alias("prediction"),
                F.when(score >= 0.5, "HIGH").otherwise("LOW").alias("risk_level"),
                F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("label"),
                F.col("o_orderdate").alias("created_at"),
            )
        )

    @cached_property
    def scored(self) -> DataFrame:
        """The evaluation shape: id, label, prediction, probability."""
        return self.predictions.select("id", "label", "prediction", F.col("risk_score").alias("probability"))

    @cached_property
    def audit_logs(self) -> DataFrame:
        eid = F.col("event_id")
        return self.raw("events").select(
            eid.alias("id"),
            F.when(eid % 10 == 0, None).when(eid % 10 == 1, F.col("user_id") + 100000000)
            .otherwise(F.col("user_id")).alias("user_id"),
            F.upper("event_type").alias("action"),
            F.col("props").alias("description"),
            F.lit(None).cast("string").alias("ip_address"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        key = F.col("p_partkey")
        return (
            self.raw("part")
            .filter(key % 10 < 3)
            .withColumn("maker", key % self._size("supplier"))
            .join(self.raw("supplier"), F.col("s_suppkey") == F.col("maker"))
            .select(
                key.alias("request_id"),
                F.when(key % 19 == 0, None).when(F.col("p_size") % 2 == 0, "Yes").otherwise("No").alias("implanted"),
                F.when(key % 23 == 0, None).when(key % 29 == 0, "no such maker").otherwise(F.col("s_name"))
                .alias("name_manufacturer"),
                F.when(key % 3 == 0, F.col("p_name")).alias("name_device"),
                *[F.lit(None).cast("string").alias(c) for c in ("type", "status", "risk_class")],
                F.when(key % 2 == 0, F.col("p_type")).alias("classification"),
                *[F.lit(None).cast("string").alias(c) for c in ("country_event", "country_device")],
                F.lit(None).cast("double").alias("quantity_in_commerce"),
                *[F.lit(None).cast("int").alias(c)
                  for c in ("event_count", "manufacturer_event_count", "event_year")],
                F.when(key % 31 == 0, 15).cast("int").alias("event_month"),
            )
        )
