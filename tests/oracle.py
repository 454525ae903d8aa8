"""Compare registered queries with their SQL on DuckDB. Usage: python tests/oracle.py [sf_dir] [name-prefix ...]."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def make_spark(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("deskgauge")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], [tuple(plain(r[i]) for i in order) for r in rows]


def sort_key(row):
    return tuple((v is None, str(type(v)) if v is None else "", str(v)) for v in row)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns differ: only spark {set(got_cols) - set(want_cols)}, only sql {set(want_cols) - set(got_cols)}"
    if len(got) != len(want):
        return f"row counts differ: spark {len(got)}, sql {len(want)}"
    got, want = sorted(got, key=sort_key), sorted(want, key=sort_key)
    for g, w in zip(got, want, strict=True):
        if g != w or [type(a) for a in g] != [type(b) for b in w]:
            bad = [(c, a, b) for c, a, b in zip(got_cols, g, w, strict=True) if a != b or type(a) is not type(b)]
            return f"first difference {bad[:4]} in row {dict(zip(got_cols[:6], g[:6], strict=False))}"
    return None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, con = make_spark(), duck(sf_dir)
    registered, sqls = queries(), oracle_sql()
    bad = 0
    for name, build in registered.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                problem = None if df.count() >= 0 else "no rows"
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.1f}s{'' if name in sqls else ' (rows only)'}", problem or "", flush=True)
    print(f"{bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
