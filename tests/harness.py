"""Compare registered queries with their SQL: python -m tests.harness SF_DIR [name prefixes...]"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels", "pages", "conversations")


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def duck(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


spark_seconds = 0.0


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark, con, root: str, name: str, fn, sql: str | None) -> str:
    started = time.time()
    df = fn(spark, root)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    global spark_seconds
    spark_seconds = time.time() - started
    if sql is None:
        return f"rows-only {len(got)}"
    rel = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})")
    want = sorted((tuple(r) for r in rel.fetchall()), key=key)
    names = sorted(con.sql(sql).columns)
    if names != cols:
        return f"FAIL columns {cols} vs {names}"
    if got == want:
        nulls = {c: sum(r[i] is None for r in got) for i, c in enumerate(cols)}
        dead = [c for c, n in nulls.items() if got and n == len(got)]
        return f"ok {len(got)}" + (f" all-null {dead}" if dead else "")
    if len(got) != len(want):
        return f"FAIL rows {len(got)} vs {len(want)}\n   first {got[:1]}\n   want  {want[:1]}"
    extra, gone = sorted(set(got) - set(want), key=key), sorted(set(want) - set(got), key=key)
    bad = list(zip(extra, gone))
    g, w = bad[0] if bad else (got[0], want[0])
    return f"FAIL values {len(bad)}/{len(got)}\n   {[(c, a, b) for c, a, b in zip(cols, g, w) if a != b][:6]}"


def main(root: str, prefixes: list[str]) -> int:
    from tidemark.catalog import load

    qs, sqls = load()
    spark, con = session(), duck(root)
    bad = 0
    for name, fn in qs.items():
        if prefixes and not any(name == p or name.startswith(p + "_") or (p.endswith("*") and name.startswith(p[:-1])) for p in prefixes):
            continue
        t = time.time()
        try:
            verdict = compare(spark, con, root, name, fn, sqls.get(name))
        except Exception as exc:  # noqa: BLE001
            verdict = "FAIL " + type(exc).__name__ + " " + str(exc)[:700]
        bad += verdict.startswith("FAIL")
        print(f"{name:34s} spark {spark_seconds:6.1f}s sql {time.time() - t - spark_seconds:5.1f}s {verdict}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
