"""The library's tables derived from the supplied ``events`` (and star-schema) tables.

Each table is a list of projections that Spark and an ANSI engine read alike, so the same text defines a
DataFrame here and a view in the checking SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.operators.running import ranged_totals
from lumenwatch.session import use_utc

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
WINDOW_SECONDS = 21_600
TTL_SECONDS = 21_600

# ``ts`` is read as an instant in UTC, so that time predicates reach the scan.
EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

LOGS = (
    "cast(event_id AS string) AS id",
    "cast(ts AS timestamp) AS timestamp",
    """CASE user_id % 6 WHEN 0 THEN 'payment-service' WHEN 1 THEN 'order-service' WHEN 2 THEN 'auth-service'
       WHEN 3 THEN 'api-gateway' WHEN 4 THEN 'fraud-service' ELSE 'inventory-service' END AS service_name""",
    """CASE WHEN event_type = 'error' AND value >= 100 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR'
       WHEN event_type = 'signup' THEN 'WARNING' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level""",
    "concat(event_type, ' by user ', user_id) AS message",
    "concat('t-', user_id) AS trace_id",
    "concat('s-', event_id) AS span_id",
    "concat('pod-', user_id % 5 + 1) AS host",
    "'production' AS environment",
    "value AS latency_ms",
    "cast(substr(props, 7, length(props) - 7) AS int) AS k",
)
ANALYSES_WHERE = "level IN ('ERROR', 'CRITICAL')"
ANALYSES = (
    "concat('an-', id) AS id",
    "timestamp AS analyzed_at",
    "service_name",
    "concat('a-', id) AS anomaly_id",
    "least(latency_ms / 150.0, 1.0) AS anomaly_score",
    """CASE WHEN latency_ms / 150.0 < 0.5 THEN 'low' WHEN latency_ms / 150.0 < 0.7 THEN 'medium'
       WHEN latency_ms / 150.0 < 0.85 THEN 'high' ELSE 'critical' END AS severity""",
    "message AS root_cause",
    "cast(k AS double) / 100 AS confidence",
    "cast(k AS double) * 40 AS analysis_duration_ms",
    "k % 10 <> 0 AS success",
    "concat('Inspect ', service_name) AS recommended_action",
    "CASE WHEN latency_ms >= 127.5 THEN 'on-call' ELSE '' END AS escalate_to",
    "k",
)
ALERTS = (
    "concat('al-', anomaly_id) AS id",
    "analyzed_at AS created_at",
    "id AS analysis_id",
    "anomaly_id",
    "service_name",
    "severity",
    "confidence",
    """CASE WHEN k % 5 < 3 THEN 'sent' WHEN k % 5 < 4 THEN 'suppressed' ELSE 'failed' END AS status""",
)
RAW_RECORDS = (
    "id",
    """CASE cast(id AS bigint) % 8
       WHEN 0 THEN concat('{"service_name":"  ', upper(service_name), ' ","level":"', lower(level), '","message":"', message,
                          '","timestamp":"', cast(timestamp AS string), '","attributes":{"latency_ms":', cast(k AS string), '}}')
       WHEN 1 THEN concat('{"resource":{"service.name":"', service_name, '"},"severity":"WARN","body":"', message,
                          '","duration_ms":"', cast(k AS string), '"}')
       WHEN 2 THEN concat('2024-01-15T12:00:00Z FATAL ', service_name, ' ', message)
       WHEN 3 THEN message
       WHEN 4 THEN concat('{"service":"', service_name, '","msg":"  ', message, '  ","time":', cast(1705300000 + k AS string),
                          ',"env":"staging","region":"eu","attributes":{"region":"us","elapsed_ms":"', cast(k AS string), '"}}')
       WHEN 5 THEN concat('{"service_name":"  ","message":"', message, '"}')
       WHEN 6 THEN concat('{"service_name":"', service_name, '","message":')
       ELSE '   ' END AS raw""",
)
# The call graph of the checking queries.
EDGES = (
    ("api-gateway", "auth-service"), ("api-gateway", "payment-service"), ("api-gateway", "order-service"),
    ("payment-service", "postgres-primary"), ("payment-service", "redis-cache"), ("payment-service", "fraud-service"),
    ("order-service", "payment-service"), ("order-service", "inventory-service"), ("order-service", "postgres-primary"),
    ("auth-service", "postgres-primary"), ("auth-service", "redis-cache"),
    ("fraud-service", "ml-model-service"), ("fraud-service", "postgres-primary"),
    ("inventory-service", "postgres-replica"),
)
BUCKET_BOUNDS = (25.0, 50.0, 100.0, 200.0, 1000.0)
# A call graph that grows with the data: gateway, regions, nations, customers and suppliers, parts.
TABLE_GRAPH = (
    ("region", "'api-gateway'", "concat('region-', r_regionkey)"),
    ("nation", "concat('region-', n_regionkey)", "concat('nation-', n_nationkey)"),
    ("customer", "concat('nation-', c_nationkey)", "concat('customer-', c_custkey)"),
    ("supplier", "concat('nation-', s_nationkey)", "concat('supplier-', s_suppkey)"),
    ("lineitem", "concat('supplier-', l_suppkey)", "concat('part-', l_partkey)"),
    ("orders", "concat('customer-', o_custkey)", "concat('order-', o_orderkey)"),
)


class Tables:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = use_utc(spark), folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def as_of(self):
        return F.expr(AS_OF)

    @property
    def logs(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(f"{self.folder}/events.parquet").selectExpr(*LOGS)

    @property
    def analyses(self) -> DataFrame:
        return self.logs.where(ANALYSES_WHERE).selectExpr(*ANALYSES)

    @property
    def alerts(self) -> DataFrame:
        return self.analyses.selectExpr(*ALERTS)

    @property
    def raw_records(self) -> DataFrame:
        return self.logs.selectExpr(*RAW_RECORDS)

    @property
    def edges(self) -> DataFrame:
        return self.spark.createDataFrame(list(EDGES), "caller STRING, callee STRING")

    @property
    def table_graph(self) -> DataFrame:
        parts = [
            self.read(table).selectExpr(f"{caller} AS caller", f"{callee} AS callee")
            for table, caller, callee in TABLE_GRAPH
        ]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        return union.distinct()

    @property
    def request_samples(self) -> DataFrame:
        """Request counters per service and status class."""
        rows = self.logs.select(
            "service_name",
            F.expr("CASE WHEN level IN ('ERROR', 'CRITICAL') THEN '500' ELSE '200' END").alias("status"),
            F.col("timestamp").alias("ts"),
            "id",
        )
        one = {"value": F.lit(1.0)}
        return ranged_totals(rows, ["service_name", "status"], ["ts", "id"], one)

    @property
    def bucket_samples(self) -> DataFrame:
        """Cumulative latency bucket counters per service."""
        rows = self.logs.select(
            "service_name",
            F.explode(F.array(*[F.lit(b) for b in BUCKET_BOUNDS])).alias("le"),
            F.col("timestamp").alias("ts"),
            "id",
            "latency_ms",
        )
        inside = {"value": F.when(F.col("latency_ms") <= F.col("le"), 1.0).otherwise(0.0)}
        return ranged_totals(rows, ["service_name", "le"], ["ts", "id"], inside)

    @property
    def gauge_samples(self) -> DataFrame:
        return self.logs.selectExpr(
            "concat(service_name, '-', host) AS pod", "timestamp AS ts", "latency_ms * 1048576 AS value"
        )


def sql_views(*names: str) -> str:
    """``WITH`` clause that defines the named tables, and what they need, for the checking SQL."""
    edges = ", ".join(f"('{a}', '{b}')" for a, b in EDGES)
    bounds = ", ".join(f"({b})" for b in BUCKET_BOUNDS)
    graph = " UNION ".join(f"SELECT {c} AS caller, {e} AS callee FROM {t}" for t, c, e in TABLE_GRAPH)
    definitions = {
        "logs": ((), f"SELECT {', '.join(LOGS)} FROM events"),
        "analyses": (("logs",), f"SELECT {', '.join(ANALYSES)} FROM logs WHERE {ANALYSES_WHERE}"),
        "alerts": (("analyses",), f"SELECT {', '.join(ALERTS)} FROM analyses"),
        "raw_records": (("logs",), f"SELECT {', '.join(RAW_RECORDS)} FROM logs"),
        "edges": ((), f"SELECT * FROM (VALUES {edges}) AS t(caller, callee)"),
        "table_graph": ((), graph),
        "rules": (
            (),
            "SELECT severity, channels, CAST(min_confidence AS DOUBLE) AS require_confidence_above, cooldown_seconds FROM "
            "(VALUES ('critical', 'pagerduty,slack', 0.50, 300), ('high', 'slack', 0.40, 300), "
            "('medium', 'slack', 0.30, 600), ('low', '', 0.0, 3600)) AS t(severity, channels, min_confidence, cooldown_seconds)",
        ),
        "request_samples": (
            ("logs",),
            """SELECT service_name, status, ts, id, CAST(row_number() OVER (PARTITION BY service_name, status ORDER BY ts, id) AS DOUBLE) AS value
               FROM (SELECT service_name, CASE WHEN level IN ('ERROR', 'CRITICAL') THEN '500' ELSE '200' END AS status,
                            timestamp AS ts, id FROM logs)""",
        ),
        "bucket_samples": (
            ("logs",),
            f"""SELECT service_name, le, timestamp AS ts, id,
                       CAST(sum(CASE WHEN latency_ms <= le THEN 1 ELSE 0 END) OVER (PARTITION BY service_name, le ORDER BY timestamp, id
                            ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value
                FROM logs CROSS JOIN (SELECT CAST(b AS DOUBLE) AS le FROM (VALUES {bounds}) AS v(b))""",
        ),
        "gauge_samples": (
            ("logs",),
            "SELECT concat(service_name, '-', host) AS pod, timestamp AS ts, latency_ms * 1048576 AS value FROM logs",
        ),
    }
    order: list[str] = []

    def need(name: str) -> None:
        for other in definitions[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({definitions[n][1]})" for n in order)
