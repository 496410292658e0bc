"""Run registered queries in Spark and their SQL in DuckDB and compare the results."""

from __future__ import annotations

import decimal
import math
import sys
import time

from checks.fixtures import TABLES

SPARK_TO_DUCK = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return str(value)
    return None if value is None else str(value)


def connect(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return db


def compare(spark, db, sf_dir: str, query, sql: str) -> list[str]:
    """Differences between a query and its SQL: columns, types and rows."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    result = db.execute(sql)
    found = {d[0]: str(d[1]).upper() for d in result.description}
    if sorted(found) != names:
        return [f"columns differ: {names} and {sorted(found)}"]
    problems = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        expected = SPARK_TO_DUCK.get(kind, kind.upper())
        if expected != found[f.name]:
            problems.append(f"{f.name}: {kind} in Spark, {found[f.name]} in SQL")
    order = [d[0] for d in result.description]
    theirs = sorted(
        (tuple(_plain(row[order.index(n)]) for n in names) for row in result.fetchall()), key=lambda r: str(r)
    )
    ours = sorted((tuple(_plain(row[n]) for n in names) for row in df.collect()), key=lambda r: str(r))
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} rows in Spark, {len(theirs)} in SQL")
    if ours != theirs:
        only_ours = [r for r in ours if r not in set(theirs)][:2]
        only_theirs = [r for r in theirs if r not in set(ours)][:2]
        problems.append(f"rows differ; only in Spark {only_ours}; only in SQL {only_theirs}")
    return problems


def main(sf_dir: str, wanted: list[str]) -> int:
    from pyspark.sql import SparkSession

    from checks import registered

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    bad = 0
    for name, (query, sql) in registered().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            if sql is None:
                problems = [] if query(spark, sf_dir).count() else ["no rows"]
            else:
                problems = compare(spark, db, sf_dir, query, sql)
        except Exception as error:  # a report over all queries, not a handler
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok':4} {name} {time.time() - started:.1f}s {'; '.join(problems)[:1500]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
