"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query writes to Spark's noop sink, so that it runs in full; reads over one imported database share its import, as
statements on a database do. `rates` gives operations a second of the single-row workloads.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (HERE, os.environ.get("PYTHONPATH"))))  # for Spark's Python workers

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
READS = {
    "scan_filter": "SELECT l_orderkey, l_cents FROM lineitem WHERE l_cents > 5000000 OR NOT l_linenumber < 6",
    "scan_all": "SELECT * FROM lineitem",
    "string_filter": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'",
    "pk_lookup": "SELECT * FROM orders WHERE o_orderkey = 4242",
    "wide_or_500": "SELECT o_orderkey FROM orders WHERE " + " OR ".join(f"o_orderkey = {3 * n}" for n in range(500)),
}
CHANGES = {
    "update_batch": "UPDATE lineitem SET l_returnflag = 'Z' WHERE l_cents > 5000000",
    "delete_batch": "DELETE FROM orders WHERE o_orderstatus = 'F'",
}


def main() -> None:
    shared = tempfile.mkdtemp(prefix="relstore-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from relstore.queries import imported, new_engine

    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    spark.range(1000).selectExpr("sum(id)").collect()  # the JVM is up
    e = None

    def load() -> None:
        nonlocal e
        e = imported(spark, SF_DIR, "lineitem", "orders")

    timed("import", load)
    for name, sql in READS.items():
        e.execute(sql).df.write.format("noop").mode("overwrite").save()
        timed(name, lambda sql=sql: e.execute(sql).df.write.format("noop").mode("overwrite").save())
    for name, sql in CHANGES.items():
        timed(name, lambda sql=sql: e.execute(sql))
    rates: dict[str, float] = {}

    def rate(name: str, statements: list[str], db) -> None:
        start = time.perf_counter()
        for sql in statements:
            r = db.execute(sql)
            if not hasattr(r, "command"):
                r.rows()
        rates[name] = round(len(statements) / (time.perf_counter() - start), 2)

    users = new_engine(spark)
    users.execute("CREATE TABLE users (id UINT32 PRIMARY KEY, username VARCHAR(64) NOT NULL, score INT64, active BOOLEAN NOT NULL)")
    rate("insert_durable_ops_s", [f"INSERT INTO users VALUES ({k}, 'user{k}', {k}, TRUE)" for k in range(200)], users)
    rate("insert_in_scope_ops_s", ["BEGIN", *(f"INSERT INTO users VALUES ({k}, 'user{k}', {k}, TRUE)" for k in range(1000, 2000)), "COMMIT"], users)
    rate("pk_lookup_ops_s", [f"SELECT * FROM users WHERE id = {k}" for k in range(20)], users)
    rate("update_pk_ops_s", [f"UPDATE users SET score = 1 WHERE id = {k}" for k in range(5)], users)
    rate("delete_pk_ops_s", [f"DELETE FROM users WHERE id = {k}" for k in range(5)], users)
    try:
        from relstore.llm import queries as llm
    except ModuleNotFoundError as x:
        if not (x.name or "").startswith("relstore.llm"):
            raise
        llm = None
    if llm is not None:
        for name, q in llm.queries().items():
            timed(name, lambda q=q: q(spark, SF_DIR).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rates": rates, "sf": SF_DIR.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
