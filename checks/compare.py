"""Run queries against DuckDB: ``python -m checks.compare SF_DIR [NAME...]``."""

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.fixtures import TABLES
from checks.registry import ORACLES, QUERIES


def duck(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _rows(records, columns) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in records)


def differences(spark, connection, sf_dir: str, name: str) -> str | None:
    """None where both engines give the same columns and rows."""
    df = QUERIES[name](spark, sf_dir)
    got = _rows(map(tuple, df.collect()), df.columns)
    relation = connection.sql(ORACLES[name])
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {df.columns} / {relation.columns}"
    expected = _rows(relation.fetchall(), relation.columns)
    if got == expected:
        return None
    extra, missing = sorted(set(got) - set(expected))[:3], sorted(set(expected) - set(got))[:3]
    return f"{len(got)} / {len(expected)} rows; only Spark {extra}; only SQL {missing}"[:1500]


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(ORACLES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem = differences(spark, connection, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:800]}"
        bad += problem is not None
        print(f"{name:24} {time.time() - start:6.1f}s {'same' if problem is None else problem}")
    print(f"{len(names) - bad} of {len(names)} the same")


if __name__ == "__main__":
    main()
