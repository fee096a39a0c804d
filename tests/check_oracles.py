"""Compare queries with their SQL on the driver tables: python tests/check_oracles.py [sf] [names]."""

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    """None when equal, else a short account of the difference."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    want = rows_of(columns, cursor.fetchall())
    if got == want:
        return None
    only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows != {len(want)} rows; only here {only[0]!r:.600}; only there {only[1]!r:.600}"


def types_of(df, con, sql):
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
    want = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    return {c: (t, want.get(c)) for c, t in df.dtypes if names.get(t, t) != want.get(c)}


def main():
    from pyspark.sql import SparkSession
    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    chosen = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf_dir, name, query, sqls[name])
                types = types_of(query(spark, sf_dir), con, sqls[name])
                problem = problem or (f"types {types}" if types else None)
                verdict = "equal" if problem is None else "DIFFERENT " + problem
            else:
                rows = query(spark, sf_dir).collect()
                problem, verdict = None, f"{len(rows)} rows {str(rows[:2])[:300]}"
        except Exception as error:
            problem = verdict = f"ERROR {str(error)[:1200]}"
        failed += problem is not None
        print(f"{name}: {verdict} ({time.time() - start:.1f}s)", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
