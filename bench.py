"""Wall time of the headline queries; prints one JSON line.

`BENCH_SF_DIR` and `BENCH_CPUS` choose the data and the cores. With
`BENCH_REPLICATE=n` the events are first copied n times with shifted ids and
users, for a load that fills the cores.

Three groups of timings: queries that start from raw messages and include the
JSON parse (`from_messages`), the same dashboard queries over the table the
ingestion job wrote (`from_table`), and streaming runs (`stream`).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import configure, plans
from millrace.session import scratch_dir
from millrace.streaming import IngestJob
from workload import messages as M
from workload.queries import AS_OF, QUERIES

FROM_MESSAGES = [
    "enrich_events", "reject_summary", "q1_hourly_volume", "q2_daily_active_users",
    "q3_purchase_revenue", "q4_ingest_health", "q5_top_error_codes", "q6_type_counts_today",
    "q7_quality_check", "dq_report", "missing_days", "tumbling_counts", "sliding_counts",
    "session_counts", "session_counts_by_type", "dedup_events", "gen_events",
]
STREAMS = ["stream_tumbling_counts", "stream_session_counts", "stream_dedup_events"]
FROM_TABLE = {
    "q1": plans.hourly_volume,
    "q2": plans.daily_active_users,
    "q3": plans.purchase_revenue,
    "q4": plans.ingest_health,
    "q5": plans.top_error_codes,
    "q6": plans.type_counts,
    "q7": plans.quality_check,
}


def run(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def seconds(work) -> float:
    begin = time.perf_counter()
    work()
    return round(time.perf_counter() - begin, 3)


def replicated(spark: SparkSession, sf_dir: str, copies: int) -> str:
    """The events `copies` times over, ids and users shifted per copy."""
    root = scratch_dir(spark, "replicated")
    rows = M.events_table(spark, sf_dir)
    shift = F.lit(rows.agg(F.max("event_id") + 1).first()[0])
    many = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    (
        many.withColumn("event_id", F.col("event_id") + F.col("_copy") * shift)
        .withColumn("user_id", F.col("user_id") + F.col("_copy") * 100_000)
        .drop("_copy")
        .repartition(int(os.environ.get("BENCH_CPUS", "8")) * 2)
        .write.parquet(f"{root}/events.parquet")
    )
    return root


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    copies = int(os.environ.get("BENCH_REPLICATE", "1"))
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    if copies > 1:
        sf_dir = replicated(spark, sf_dir, copies)
    events = M.events_table(spark, sf_dir).count()

    run(QUERIES["enrich_events"](spark, sf_dir))  # warm-up: classes, code generation
    timings = {name: seconds(lambda n=name: run(QUERIES[n](spark, sf_dir))) for name in FROM_MESSAGES}

    root = scratch_dir(spark, "bench")
    job = IngestJob(f"{root}/events", f"{root}/letters", clock=F.col("publish_time"))
    stream = M.as_messages(M.events_stream(spark, sf_dir))
    timings["stream_ingest"] = seconds(
        lambda: job.start(stream, f"{root}/checkpoint").awaitTermination()
    )
    for name, query in FROM_TABLE.items():
        timings[f"table_{name}"] = seconds(
            lambda q=query: run(plans.over_table(q, spark, job.events_root, AS_OF))
        )
    for name in STREAMS:
        timings[name] = seconds(lambda n=name: run(QUERIES[n](spark, sf_dir)))

    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": scale,
                "events": events,
                "ingest_rows_per_sec": round(events / timings["stream_ingest"]),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
