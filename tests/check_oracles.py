"""Compare every query with its checking SQL: ``python tests/check_oracles.py [folder] [name ...]``."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def compare(spark, db, build, sql, folder):
    """None when equal, else what differs."""
    df = build(spark, folder)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}: {got[:1]} {want[:1]}"
    if not got:
        return "both empty"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, e.g. {wrong[0]}"
    types = {type(a).__name__ + "/" + type(b).__name__ for g, w in zip(got, want) for a, b in zip(g, w) if a is not None and type(a) is not type(b)}
    return f"types {types}" if types else None


def main() -> None:
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, db = session(), database(folder)
    oracles, failed, names = entry.oracle_sql(), 0, []
    for name, build in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        names.append(name)
        started = time.time()
        try:
            problem = compare(spark, db, build, oracles.get(name), folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        took = time.time() - started
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s {'' if name in oracles else '(rows only) '}{problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main()
