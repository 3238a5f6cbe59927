"""Where the registered queries and their reference SQL are collected."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def exact_rounding(sql: str) -> str:
    """Write round_even(x, n) as a printf round trip, which rounds the exact binary value."""
    while (at := sql.find("round_even(")) >= 0:
        depth, end, comma = 0, at + 10, None
        for end in range(at + 10, len(sql)):
            ch = sql[end]
            depth += (ch in "([{") - (ch in ")]}")
            if depth == 1 and ch == ",":
                comma = end
            if depth == 0:
                break
        value, digits = sql[at + 11:comma], sql[comma + 1:end].strip()
        sql = (sql[:at] + f"CAST(printf('%.{digits}f', CAST({value} AS DOUBLE)) AS DOUBLE)"
               + sql[end + 1:])
    return sql


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with the SQL that must agree with it."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = exact_rounding(sql)
        return fn

    return register


def table(spark, sf_dir: str, name: str):
    """A driver table.  Text tables that come as fewer files than there are cores are spread
    over the cores; a table of many files is read as it is, without that shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and len(df.inputFiles()) < cores:
        df = df.repartition(cores)
    return df
