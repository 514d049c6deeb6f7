"""One query for each operator of the dialect and its storage, and the SQL that must agree."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .errors import RelError
from .result import CommandResult, format_result
from .types import Column

# -- the driver's tables ---------------------------------------------------------------------------------------------


def u(name: str, of: str | None = None, key: bool = False) -> tuple[str, Column]:
    return of or name, Column(name, "UINT32", not key, key)


def i(name: str, of: str | None = None) -> tuple[str, Column]:
    return of or name, Column(name, "INT64")


def s(name: str, n: int) -> tuple[str, Column]:
    return name, Column(name, "VARCHAR", max_bytes=n)


def b(name: str, of: str) -> tuple[str, Column]:
    return of, Column(name, "BOOLEAN")


def key(name: str) -> tuple[str, Column]:
    return u(name, key=True)


#: Columns outside the four types are left out, or come in as whole numbers.
TABLES: dict[str, list[tuple[str, Column]]] = {
    "region": [key("r_regionkey"), s("r_name", 64)],
    "nation": [key("n_nationkey"), s("n_name", 64), i("n_regionkey")],
    "customer": [key("c_custkey"), s("c_name", 64), i("c_nationkey"), i("c_cents", "CAST(round(c_acctbal * 100) AS BIGINT)"), s("c_mktsegment", 32)],
    "part": [key("p_partkey"), s("p_name", 128), s("p_brand", 32), s("p_type", 64), i("p_size")],
    "orders": [key("o_orderkey"), i("o_custkey"), s("o_orderstatus", 8), s("o_orderpriority", 32)],
    "lineitem": [i("l_orderkey"), i("l_partkey"), i("l_linenumber"), i("l_cents", "CAST(round(l_extendedprice * 100) AS BIGINT)"), s("l_returnflag", 8)],
    "labels": [key("doc_id"), b("quality", "quality = 1"), b("toxic", "toxic = 1")],
}
_SQL = {
    "region": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region",
    "nation": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "customer": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS c_cents, c_mktsegment FROM customer",
    "part": "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size FROM part",
    "orders": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders",
    "lineitem": "SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS l_cents, l_returnflag FROM lineitem",
    "labels": "SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic FROM labels",
}


def new_engine(spark: SparkSession, **options) -> Engine:
    """An empty database in a folder of its own, which goes when the program ends.

    It lies in the shared folder where the session names one, and else in a temporary one (local mode).
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared and not shared.startswith("file:"):
        import uuid

        return Engine.open(f"{shared}/relstore-{uuid.uuid4().hex}", spark, **options)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = "/" + shared[5:].lstrip("/") if shared else None
    if root:
        import os

        os.makedirs(root, exist_ok=True)
    path = tempfile.mkdtemp(prefix="relstore-db-", dir=root)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return Engine.open(path, spark, **options)


def imported(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    e = new_engine(spark)
    for n in names:
        e.import_parquet(n, f"{sf_dir}/{n}.parquet", TABLES[n])
    return e


# -- queries ---------------------------------------------------------------------------------------------------------


def _read(table: str, sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return imported(spark, sf_dir, table).execute(sql).df


def _changed(table: str, statements: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    e = imported(spark, sf_dir, table)
    for sql in statements:
        e.execute(sql)
    return e.table(table)


def _tried(table: str, statements: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after statements of which some fail; an error of one doesn't stop the others."""
    e = imported(spark, sf_dir, table)
    for sql in statements:
        _attempt(e, sql)
    return e.table(table)


def _two_steps(spark: SparkSession, sf_dir: str, table: str, changes: list[str], select: str) -> DataFrame:
    e = imported(spark, sf_dir, table)
    for sql in changes:
        e.execute(sql)
    return e.execute(select).df


def _attempt(e: Engine, sql: str) -> str:
    """The kind of error that a statement gives, or "none"."""
    try:
        e.execute(sql)
        return "none"
    except RelError as x:
        return x.kind


def _copied(create: str, target: str, insert: str, source: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new table with one INSERT for each row of a small source table; insert is formatted with the row's cells as literals."""
    e = imported(spark, sf_dir, source)
    e.execute(create)
    e.execute("BEGIN")
    for row in e.execute(f"SELECT * FROM {source}").rows():
        cells = ["NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row]
        e.execute(insert.format(*cells))
    e.execute("COMMIT")
    return e.table(target)


WIDE = " OR ".join(f"o_orderkey = {3 * n}" for n in range(500))

def _select_entry(table: str, columns: str, where: str | None, oracle: str | None = None):
    """(query, SQL): a SELECT over an imported table and the same over its form in SQL."""
    sql = f"SELECT {columns} FROM {table}" + (f" WHERE {where}" if where else "")
    condition = oracle if oracle is not None else where
    return partial(_read, table, sql), f"SELECT {columns} FROM ({_SQL[table]}) AS t" + (f" WHERE {condition}" if condition else "")


def _values(columns: list[str], rows: list[tuple], types: list[str]) -> str:
    def cell(v) -> str:
        return "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in zip(columns, types, strict=True))
    return f"SELECT {casts} FROM (VALUES {body}) AS v({', '.join(columns)})"


def _stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = imported(spark, sf_dir, "region")
    rows = []
    for n, sql in enumerate(
        [
            "SELECT * FROM region",
            "SELECT r_name FROM region WHERE r_regionkey = 1",
            "SELECT r_name FROM region WHERE 99 = r_regionkey",
            "SELECT r_name FROM region WHERE r_regionkey = 1 AND r_regionkey = 2",
            "SELECT r_name FROM region WHERE r_regionkey = NULL",
            "SELECT r_name FROM region WHERE NOT r_regionkey = 1",
            "UPDATE region SET r_name = 'x' WHERE r_regionkey = 3",
            "DELETE FROM region WHERE r_name = 'x'",
            "INSERT INTO region VALUES (77, 'new')",
            "BEGIN",
            "COMMIT",
        ]
    ):
        r = e.execute(sql)
        st = r.stats
        rows.append((n, st.access_path, st.rows_examined, st.rows_returned, st.index_lookups, r.affected_rows if isinstance(r, CommandResult) else 0))
    return spark.createDataFrame(rows, "n long, access_path string, rows_examined long, rows_returned long, index_lookups long, affected long")


_STATS = [
    (0, "HeapScan", 5, 5, 0, 0),
    (1, "PrimaryKeyLookup", 1, 1, 1, 0),
    (2, "PrimaryKeyLookup", 0, 0, 1, 0),
    (3, "PrimaryKeyLookup", 1, 0, 1, 0),
    (4, "HeapScan", 5, 0, 0, 0),
    (5, "HeapScan", 5, 4, 0, 0),
    (6, "PrimaryKeyLookup", 1, 1, 1, 1),
    (7, "HeapScan", 5, 1, 0, 1),
    (8, "None", 0, 0, 0, 1),
    (9, "None", 0, 0, 0, 0),
    (10, "None", 0, 0, 0, 0),
]

#: Statements over nation, 25 rows with keys 0 to 24, and the kind of error that each gives.
_ERRORS = [
    ("DELETE FROM nation /* never closed", "Lexer"),
    ("UPDATE nation SET n_name = 'never closed", "Lexer"),
    ("SELECT n_name FROM nation WHERE n_regionkey !> 1", "Lexer"),
    ("SELECT n_name FROM nation WHERE 0 < n_regionkey < 3", "Parser"),
    ("SELECT n_name FROM nation WHERE n_regionkey IN (1)", "Parser"),
    ("DELETE nation", "Parser"),
    ("SELECT n_population FROM nation", "Semantic"),
    ("SELECT n_name FROM planets", "Semantic"),
    ("SELECT n_name FROM nation WHERE n_name > 4", "Semantic"),
    ("SELECT n_name FROM nation WHERE n_nationkey <> n_regionkey", "Semantic"),
    ("SELECT n_name FROM nation WHERE NOT n_regionkey", "Semantic"),
    ("SELECT n_name FROM nation WHERE n_nationkey > -3", "Constraint"),
    (f"SELECT n_nationkey FROM nation WHERE n_name < '{'N' * 65}'", "Constraint"),
    ("CREATE TABLE nation (n_area INT64)", "Constraint"),
    ("CREATE TABLE cities (c_name VARCHAR(9), C_NAME INT64)", "Semantic"),
    ("CREATE TABLE cities (c_name VARCHAR(9) PRIMARY KEY)", "Semantic"),
    ("CREATE TABLE cities (c_name VARCHAR(4001))", "Semantic"),
    ("CREATE TABLE cities (c_name VARCHAR(99999999999))", "Constraint"),
    ("INSERT INTO nation VALUES (30, 'N')", "Semantic"),
    ("INSERT INTO nation VALUES (30, 4, 4)", "Semantic"),
    ("INSERT INTO nation (n_nationkey, n_name, N_NAME) VALUES (30, 'N', 'N')", "Semantic"),
    ("INSERT INTO nation (n_name) VALUES ('keyless')", "Constraint"),
    ("INSERT INTO nation VALUES (24, 'taken', 1)", "Constraint"),
    ("INSERT INTO nation VALUES (30, 'N', 9223372036854775808)", "Constraint"),
    ("UPDATE nation SET n_nationkey = 77 WHERE n_regionkey = 2", "Constraint"),
    ("UPDATE nation SET n_nationkey = 4 WHERE n_nationkey = 5", "Constraint"),
    ("UPDATE nation SET n_regionkey = 4, N_REGIONKEY = 4", "Semantic"),
    ("UPDATE nation SET n_nationkey = NULL WHERE n_nationkey > 1000", "Constraint"),
    ("ROLLBACK", "Execution"),
    ("COMMIT", "Execution"),
]


def _error_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = imported(spark, sf_dir, "nation")
    return spark.createDataFrame([(n, _attempt(e, sql)) for n, (sql, _) in enumerate(_ERRORS)], "n long, kind string")


#: A foreign token in the named line and column of an otherwise valid statement.
_PLACES = [("SELECT n_name\nFROM nation\n  WHERE ;", 3, 9), ("UPDATE nation SET\r\n n_name : 'x'", 2, 9), ("DELETE\tFROM 5", 1, 13), ("SELECT n_name FROM nation WHERE\n\n n_name = n_size", 3, 11)]


def _error_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, rows = imported(spark, sf_dir, "nation"), []
    for n, (sql, _, _) in enumerate(_PLACES):
        try:
            e.execute(sql)
        except RelError as x:
            rows.append((n, x.span.begin.line, x.span.begin.column))
    return spark.createDataFrame(rows, "n long, line long, place long")


def _nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each depth of parentheses around a condition, whether it is taken."""
    e = imported(spark, sf_dir, "region")
    depths = [1, 64, 127, 128, 129, 400]
    return spark.createDataFrame([(d, _attempt(e, "SELECT * FROM region WHERE " + "(" * d + "r_regionkey = 1" + ")" * d) == "none") for d in depths], "depth long, taken boolean")


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition for each region, as the tree prints it."""
    from .plans.parser import parse
    from .plans.tree import debug

    e = imported(spark, sf_dir, "region")
    rows = [(k, debug(parse(f"SELECT * FROM region WHERE r_regionkey <> {k} AND NOT r_name = '{name}' OR FALSE").where)) for k, name in e.execute("SELECT * FROM region").rows()]
    return spark.createDataFrame(rows, "r_regionkey long, form string")


def _gate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer waits for the open reader, and goes before the reader that comes after it."""
    import threading

    from .gate import Gate

    gate, order = Gate(), []
    gate.read()
    writer = threading.Thread(target=lambda: (gate.write(), order.append("writer"), gate.done_writing()))
    writer.start()
    while not gate._writers_waiting:
        pass
    later = threading.Thread(target=lambda: (gate.read(), order.append("later reader"), gate.done_reading()))
    later.start()
    order.append("first reader")
    gate.done_reading()
    writer.join()
    later.join()
    return spark.createDataFrame(list(enumerate(order)), "n long, who string")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = imported(spark, sf_dir, "region")
    for scope in (["COMMIT"], ["ROLLBACK"], ["DELETE FROM region WHERE r_regionkey = 'x'"], ["DELETE FROM region WHERE r_regionkey = 1", "COMMIT"]):
        for sql in ["BEGIN", *scope]:
            _attempt(e, sql)
    c = e.counters
    return spark.createDataFrame([("begun", c.begun), ("committed", c.committed), ("rolled back", c.rolled_back), ("rolled back by errors", c.auto_rolled_back)], "what string, n long")


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small commits become few files by themselves, with the rows that were committed."""
    e = new_engine(spark, compact_files=4)
    e.create("nation", [c for _, c in TABLES["nation"]])
    source = imported(spark, sf_dir, "nation").table("nation")
    for k in range(5):
        e.append("nation", source.filter(f"n_nationkey % 5 = {k}"))
    if len(e.catalog.now.tables["nation"].files) >= 5:
        raise AssertionError("the files were not compacted")
    return e.table("nation")


def _command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    import contextlib
    import io

    from .__main__ import run

    e, out, err = imported(spark, sf_dir, "region"), io.StringIO(), io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        codes = [run(e, sql, False) for sql in ("UPDATE region SET r_name = 'x' WHERE r_regionkey > 2", "DELETE region")]
    lines = out.getvalue().splitlines() + [err.getvalue().partition(":")[0]] + [str(c) for c in codes]
    return spark.createDataFrame(list(enumerate(lines)), "n long, line string")


def _reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a closed database keeps: committed changes, not those of an open scope."""
    e = imported(spark, sf_dir, "nation")
    for sql in ("DELETE FROM nation WHERE n_regionkey = 0", "BEGIN", "DELETE FROM nation"):
        e.execute(sql)
    e.close()
    again = Engine.open(e.store.root, spark)
    again.execute("UPDATE nation SET n_name = 'after' WHERE n_regionkey = 1")
    return again.table("nation")


def _ddl_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = imported(spark, sf_dir, "nation")
    for end in ("ROLLBACK", "COMMIT"):
        for sql in ("BEGIN", f"CREATE TABLE made_before_{end} (a INT64)", end):
            e.execute(sql)
    return spark.createDataFrame([(n,) for n in e.table_names()], "table_name string")


def _own_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = imported(spark, sf_dir, "nation")
    for sql in ("BEGIN", "INSERT INTO nation VALUES (100, 'new', NULL)", "UPDATE nation SET n_regionkey = 9 WHERE n_regionkey = 2", "DELETE FROM nation WHERE n_nationkey < 3"):
        e.execute(sql)
    seen = e.execute("SELECT * FROM nation").df
    e.execute("ROLLBACK")
    return seen


def _range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imported(spark, sf_dir, "orders").range_scan("orders", 100, 1000)


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imported(spark, sf_dir, "nation").scan_ordered("nation")


def _by_key_and_rid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = imported(spark, sf_dir, "nation")
    e.update_key("nation", 3, {"n_name": "THREE"})
    e.erase_key("nation", 4)
    rid = e.rows("nation").filter("n_nationkey = 5").first()[0]
    e.update_rid("nation", rid, {"n_regionkey": 99})
    e.erase_rid("nation", e.rows("nation").filter("n_nationkey = 6").first()[0])
    e.insert("nation", (1000, "NEW", None))
    e.validate()
    return e.get("nation", rid).union(e.find("nation", 3)).union(e.table("nation"))


def _bulk_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = new_engine(spark)
    e.create("orders", [c for _, c in TABLES["orders"]])
    source = imported(spark, sf_dir, "orders").table("orders")
    for batch, part in ((0, "o_orderkey < 500"), (0, "o_orderkey < 500"), (1, "o_orderkey >= 500")):
        e.append("orders", source.filter(part), batch=("load", batch))
    e.compact("orders")
    return e.table("orders")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.ingest import append_stream

    e = new_engine(spark)
    e.create("events", [u("event_id", key=True)[1], i("user_id")[1], s("event_type", 16)[1]])
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A file source reads folders; the glob makes one of the table's file or folder.
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select("event_id", "user_id", "event_type")
    append_stream(e, "events", source, e.store.path("stream")).awaitTermination()
    return e.table("events")


def _cli_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = imported(spark, sf_dir, "region")
    text = format_result(e.execute("SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 1"), True)
    text += format_result(e.execute("DELETE FROM region WHERE r_regionkey = 1")) + format_result(e.execute("BEGIN"))
    return spark.createDataFrame([(n, line) for n, line in enumerate(text.rstrip("\n").split("\n"))], "n long, line string")


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .client import Client
    from .server import Server

    with Server(imported(spark, sf_dir, "region")) as server, Client(server.address) as client:
        client.execute("UPDATE region SET r_name = 'renamed' WHERE r_regionkey = 2")
        got = client.execute("SELECT r_regionkey, r_name FROM region")
    return spark.createDataFrame(got.rows, "r_regionkey long, r_name string")


_ORDERS_WHERE = "o_orderkey >= 100 AND (o_orderstatus = 'F' OR NOT o_custkey < 50)"
#: Changes of a scope, and what is left of nation if they are kept.
_SCOPE = ["INSERT INTO nation VALUES (100, 'new', NULL)", "UPDATE nation SET n_regionkey = 9 WHERE n_regionkey = 2", "DELETE FROM nation WHERE n_nationkey < 3"]
_PAIR = _SQL["nation"]
_AFTER_SCOPE = f"SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN 9 ELSE n_regionkey END AS n_regionkey FROM ({_PAIR}) AS t WHERE n_nationkey >= 3 UNION ALL SELECT 100, 'new', NULL"

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "filter_orders": _select_entry("orders", "o_orderkey, o_orderstatus", _ORDERS_WHERE),
    "select_star": _select_entry("nation", "*", None),
    "project_order": _select_entry("customer", "c_name, c_custkey", None),
    "pk_lookup": _select_entry("orders", "*", "o_orderkey = 42"),
    "pk_lookup_reversed": _select_entry("orders", "o_custkey", "42 = O_ORDERKEY"),
    "pk_and_residual": _select_entry("orders", "o_orderkey", "o_custkey >= 0 AND o_orderkey = 7"),
    "pk_two_literals": _select_entry("orders", "o_orderkey", "o_orderkey = 1 AND o_orderkey = 2"),
    "pk_miss": _select_entry("orders", "o_orderkey", "o_orderkey = 4294967295"),
    "eq_string": _select_entry("customer", "c_custkey, c_mktsegment", "c_mktsegment = 'BUILDING'"),
    "ne_bang": _select_entry("customer", "c_custkey", "c_mktsegment != 'BUILDING'"),
    "ne_ltgt": _select_entry("customer", "c_custkey", "c_mktsegment <> 'BUILDING'"),
    "lt": _select_entry("lineitem", "l_orderkey, l_cents", "l_cents < 500000"),
    "le": _select_entry("lineitem", "l_orderkey, l_linenumber", "l_linenumber <= 2"),
    "gt": _select_entry("lineitem", "l_orderkey, l_cents", "l_cents > 5000000"),
    "ge": _select_entry("lineitem", "l_orderkey, l_linenumber", "3 <= l_linenumber AND l_linenumber >= 5"),
    "range_and": _select_entry("lineitem", "l_orderkey, l_partkey", "l_partkey >= 10 AND l_partkey < 60"),
    "column_to_column": _select_entry("lineitem", "l_orderkey, l_partkey", "l_orderkey < l_partkey"),
    "str_order": _select_entry("part", "p_partkey, p_name", "p_name > 'blue ' AND p_name <= 'red widget'"),
    "str_order_bytes": (
        lambda spark, d: _two_steps(spark, d, "nation", ["UPDATE nation SET n_name = 'Élan' WHERE n_regionkey = 1", "UPDATE nation SET n_name = 'zebra' WHERE n_regionkey = 2", "UPDATE nation SET n_name = 'Zoo' WHERE n_regionkey = 3"], "SELECT n_nationkey FROM nation WHERE n_name > 'a' AND NOT n_name <= 'zebra'"),
        f"SELECT n_nationkey FROM ({_PAIR}) AS t WHERE n_regionkey = 1",
    ),
    "and_or_not": _select_entry("orders", "o_orderkey", "o_orderstatus = 'O' OR o_orderstatus = 'P' AND NOT o_custkey > 100"),
    "not_precedence": _select_entry("orders", "o_orderkey", "NOT o_orderstatus = 'O' AND o_custkey < 500"),
    "parens": _select_entry("orders", "o_orderkey", "(o_orderstatus = 'O' OR o_orderstatus = 'P') AND ((o_custkey) < (500))"),
    "bool_bare": _select_entry("labels", "doc_id", "toxic"),
    "bool_eq": _select_entry("labels", "doc_id, quality", "quality = FALSE AND toxic <> TRUE"),
    "bool_columns": _select_entry("labels", "doc_id", "quality = toxic"),
    "pred_eq_bool": _select_entry("labels", "doc_id", "(doc_id > 100) = quality"),
    "null_eq": _select_entry("region", "r_regionkey", "r_name = NULL OR NULL = NULL"),
    "null_where": _select_entry("region", "r_regionkey", "NULL"),
    "not_null_eq": _select_entry("region", "r_regionkey", "NOT r_name = NULL"),
    "null_or_true": _select_entry("region", "r_regionkey", "NULL OR r_regionkey > 1"),
    "bignum_literals": _select_entry("region", "r_regionkey", f"{'9' * 60} > {'8' * 60} AND -0 = 0 AND r_regionkey > 0", "r_regionkey > 0"),
    "wide_or_500": _select_entry("orders", "o_orderkey", WIDE, f"o_orderkey IN ({', '.join(str(3 * n) for n in range(500))})"),
    "wide_mixed": _select_entry("orders", "o_orderkey", " OR ".join(f"o_orderkey = {n} AND o_custkey > {n % 7}" for n in range(400))),
    "select_repeated": (lambda spark, d: imported(spark, d, "region").execute("SELECT r_name, R_NAME FROM region").df.toDF("a", "b"), "SELECT r_name AS a, r_name AS b FROM region"),
    "create_insert_select": (
        partial(_copied, "CREATE TABLE copy (k UINT32 PRIMARY KEY, v VARCHAR(64) NOT NULL, r INT64, low BOOLEAN)", "copy", "INSERT INTO copy VALUES ({0}, {1}, {2}, NULL)", "nation"),
        f"SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r, CAST(NULL AS BOOLEAN) AS low FROM ({_PAIR}) AS t",
    ),
    "insert_partial_nulls": (
        partial(_copied, "CREATE TABLE copy (k UINT32 PRIMARY KEY, v VARCHAR(64), r INT64, late BOOLEAN NOT NULL)", "copy", "INSERT INTO copy (late, R, k) VALUES (TRUE, {2}, {0})", "nation"),
        f"SELECT n_nationkey AS k, CAST(NULL AS VARCHAR) AS v, n_regionkey AS r, TRUE AS late FROM ({_PAIR}) AS t",
    ),
    "insert_literals": (
        partial(_tried, "region", ["INSERT INTO region VALUES (4294967295, 'it''s')", "INSERT INTO region VALUES (90, '\\n')", "INSERT INTO region VALUES (90, 'again')", "INSERT INTO region (r_regionkey) VALUES (91)"]),
        f"{_SQL['region']} UNION ALL SELECT 4294967295, 'it''s' UNION ALL SELECT 90, '\\n' UNION ALL SELECT 91, NULL",
    ),
    "update_all": (partial(_changed, "customer", ["UPDATE customer SET c_mktsegment = 'X', c_cents = -1"]), f"SELECT c_custkey, c_name, c_nationkey, CAST(-1 AS BIGINT) AS c_cents, 'X' AS c_mktsegment FROM ({_SQL['customer']}) AS t"),
    "update_where": (
        partial(_changed, "customer", ["UPDATE customer SET c_name = 'renamed' WHERE c_cents < 0 OR c_nationkey = 3"]),
        f"SELECT c_custkey, CASE WHEN c_cents < 0 OR c_nationkey = 3 THEN 'renamed' ELSE c_name END AS c_name, c_nationkey, c_cents, c_mktsegment FROM ({_SQL['customer']}) AS t",
    ),
    "update_null": (
        partial(_changed, "nation", ["UPDATE nation SET n_regionkey = NULL WHERE n_regionkey = 1", "UPDATE nation SET n_name = 'seen' WHERE NOT n_regionkey = 2"]),
        f"SELECT n_nationkey, CASE WHEN n_regionkey NOT IN (1, 2) THEN 'seen' ELSE n_name END AS n_name, CASE WHEN n_regionkey <> 1 THEN n_regionkey END AS n_regionkey FROM ({_PAIR}) AS t",
    ),
    "update_pk": (
        partial(_changed, "nation", ["UPDATE nation SET n_nationkey = 500 WHERE n_nationkey = 7", "UPDATE nation SET n_nationkey = 8 WHERE n_nationkey = 8"]),
        f"SELECT CASE WHEN n_nationkey = 7 THEN 500 ELSE n_nationkey END AS n_nationkey, n_name, n_regionkey FROM ({_PAIR}) AS t",
    ),
    "delete_where": (partial(_changed, "orders", ["DELETE FROM orders WHERE o_orderstatus = 'F' AND o_custkey > 10"]), f"SELECT * FROM ({_SQL['orders']}) AS t WHERE NOT (o_orderstatus = 'F' AND o_custkey > 10)"),
    "delete_all": (partial(_changed, "orders", ["DELETE FROM orders"]), f"SELECT * FROM ({_SQL['orders']}) AS t WHERE FALSE"),
    "delete_unknown_kept": (
        partial(_changed, "nation", ["UPDATE nation SET n_regionkey = NULL WHERE n_regionkey = 1", "DELETE FROM nation WHERE n_regionkey > 2"]),
        f"SELECT n_nationkey, n_name, CASE WHEN n_regionkey <> 1 THEN n_regionkey END AS n_regionkey FROM ({_PAIR}) AS t WHERE n_regionkey <= 2",
    ),
    "txn_commit": (partial(_changed, "nation", ["BEGIN", *_SCOPE, "COMMIT"]), _AFTER_SCOPE),
    "txn_rollback": (partial(_changed, "nation", ["BEGIN TRANSACTION", *_SCOPE, "ROLLBACK", "DELETE FROM nation WHERE n_nationkey = 5"]), f"SELECT * FROM ({_PAIR}) AS t WHERE n_nationkey <> 5"),
    # A statement that can't be parsed or a failed SELECT leave the scope open; a failed change ends it.
    "txn_error_rollback": (
        partial(_tried, "nation", ["BEGIN", _SCOPE[2], "SELECT n_size FROM nation", "DELETE DELETE", "INSERT INTO nation VALUES (9, 'taken', 0)", "COMMIT", _SCOPE[1]]),
        f"SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN 9 ELSE n_regionkey END AS n_regionkey FROM ({_PAIR}) AS t",
    ),
    "txn_errors_that_keep_it": (partial(_tried, "nation", ["BEGIN", *_SCOPE, "SELECT n_size FROM nation", "DELETE DELETE", "BEGIN", "COMMIT"]), _AFTER_SCOPE),
    "txn_own_writes": (_own_writes, _AFTER_SCOPE),
    "txn_ddl_rollback": (_ddl_rollback, _values(["table_name"], [("nation",), ("made_before_commit",)], ["VARCHAR"])),
    "txn_readonly": (partial(_tried, "nation", ["BEGIN READ ONLY", *_SCOPE, "SELECT * FROM nation", "COMMIT", "DELETE FROM nation WHERE n_regionkey = 4"]), f"SELECT * FROM ({_PAIR}) AS t WHERE n_regionkey <> 4"),
    "txn_counters": (_counted, _values(["what", "n"], [("begun", 4), ("committed", 2), ("rolled back", 1), ("rolled back by errors", 1)], ["VARCHAR", "BIGINT"])),
    "gate_order": (_gate_order, _values(["n", "who"], [(0, "first reader"), (1, "writer"), (2, "later reader")], ["BIGINT", "VARCHAR"])),
    "nesting_limit": (_nesting, "SELECT depth, depth <= 128 AS taken FROM (SELECT CAST(unnest([1, 64, 127, 128, 129, 400]) AS BIGINT) AS depth)"),
    "tree_printer": (
        _printed,
        f"SELECT r_regionkey, 'Or(And(Ne(Id(r_regionkey),Int(' || r_regionkey || ')),Not(Eq(Id(r_name),String(\"' || r_name || '\")))),Bool(false))' AS form FROM ({_SQL['region']}) AS t",
    ),
    "error_places": (_error_places, _values(["n", "line", "place"], [(n, line, place) for n, (_, line, place) in enumerate(_PLACES)], ["BIGINT", "BIGINT", "BIGINT"])),
    "auto_compaction": (_compacted, _PAIR),
    "command_line": (
        _command_line,
        "WITH t AS (SELECT count(*) AS n FROM region WHERE r_regionkey > 2) SELECT CAST(n AS BIGINT) AS n, line FROM (VALUES (0, 'UPDATE'), (2, 'Parser error'), (3, '0'), (4, '1')) AS v(n, line) "
        "UNION ALL SELECT 1, n || CASE WHEN n = 1 THEN ' row affected' ELSE ' rows affected' END FROM t",
    ),
    "pk_range_scan": (_range_scan, f"SELECT * FROM ({_SQL['orders']}) AS t WHERE o_orderkey BETWEEN 100 AND 1000"),
    "ordered_index_scan": (_ordered, _PAIR),
    "by_key_and_rid": (
        _by_key_and_rid,
        f"WITH t AS ({_PAIR}), n AS (SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'THREE' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 5 THEN 99 ELSE n_regionkey END AS n_regionkey FROM t WHERE n_nationkey NOT IN (4, 6) "
        "UNION ALL SELECT 1000, 'NEW', NULL) SELECT * FROM n UNION ALL SELECT * FROM n WHERE n_nationkey IN (3, 5)",
    ),
    "bulk_append": (_bulk_append, _SQL["orders"]),
    "stream_append": (_stream, "SELECT event_id, user_id, event_type FROM events"),
    "stats_report": (_stats_report, _values(["n", "access_path", "rows_examined", "rows_returned", "index_lookups", "affected"], _STATS, ["BIGINT", "VARCHAR", "BIGINT", "BIGINT", "BIGINT", "BIGINT"])),
    "error_catalogue": (_error_catalogue, _values(["n", "kind"], [(n, k) for n, (_, k) in enumerate(_ERRORS)], ["BIGINT", "VARCHAR"])),
    "reopen_durable": (_reopen, f"SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'after' ELSE n_name END AS n_name, n_regionkey FROM ({_PAIR}) AS t WHERE n_regionkey <> 0"),
    "cli_text": (
        _cli_text,
        "WITH r AS (SELECT r_name, CAST(greatest(length(r_name), 6) AS INTEGER) AS w FROM region WHERE r_regionkey = 1) "
        "SELECT CAST(0 AS BIGINT) AS n, 'r_regionkey | ' || rpad('r_name', w, ' ') AS line FROM r UNION ALL SELECT 1, '------------+-' || repeat('-', w) FROM r UNION ALL SELECT 2, '1           | ' || rpad(r_name, w, ' ') FROM r "
        "UNION ALL SELECT * FROM (VALUES (3, '1 row'), (4, 'access: PrimaryKeyLookup'), (5, 'rows examined: 1'), (6, 'rows returned: 1'), (7, 'index lookups: 1'), (8, 'DELETE'), (9, '1 row affected'), (10, 'BEGIN'), (11, 'OK')) AS v(n, line)",
    ),
    "wire_round_trip": (_wire, "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CASE WHEN r_regionkey = 2 THEN 'renamed' ELSE r_name END AS r_name FROM region"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in ENTRIES.items()}
