"""Fixed schemas of the telemetry tables.

Tables keep every snapshot (``snapshot_id``); the latest row per key is a view
made by :func:`flowgauge.sources.writers.upsert_state`. Counters that a
long-running cluster can push past 2^31 are longs.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "timestamp": T.TimestampType(),
}


def _struct(spec: str) -> T.StructType:
    """Schema of ``name type`` pairs; needs no running session."""
    pairs = (item.split() for item in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LOAD = _struct(
    "topology_id string, task_id int, ts timestamp, worker_hostname string, "
    "worker_port int, load bigint"
)
TRAFFIC = _struct(
    "topology_id string, source_task_id int, destination_task_id int, ts timestamp, traffic bigint"
)
WORKER = _struct("hostname string, port int, ts timestamp, cpu_usage int")
NODE = _struct("hostname string, core_count int, core_speed bigint")
TUPLESIZE = _struct(
    "topology_id string, source_task_id int, destination_task_id int, ts timestamp, "
    "tuplesizesum bigint, tuplesizecount bigint"
)

TABLES = {
    "load": LOAD,
    "traffic": TRAFFIC,
    "worker": WORKER,
    "node": NODE,
    "tuplesize": TUPLESIZE,
}

KEYS = {
    "load": ["topology_id", "task_id"],
    "traffic": ["topology_id", "source_task_id", "destination_task_id"],
    "worker": ["hostname", "port"],
    "node": ["hostname"],
    "tuplesize": ["topology_id", "source_task_id", "destination_task_id"],
}

WORKER_HISTORY = _struct("host string, traffic_in bigint, traffic_out bigint, load bigint, cpu int")
LOAD_HISTORY = _struct("component string, traffic bigint, load bigint")
LATENCY_LOG = _struct("ts_ms bigint, latency_ns bigint")
THROUGHPUT_LOG = _struct("ts_ms bigint, cnt bigint")
