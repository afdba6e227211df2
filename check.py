"""Compare every registered query with its SQL on one scale: `python check.py [name ...]`."""

import os
import sys
import time

import duckdb

from loomtrace.plans import registry
from loomtrace.session import build_session

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def main(names):
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": os.environ.get("SHUFFLE", "8"), "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for file in os.listdir(SF_DIR):
        duck.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    queries, oracles = registry.queries(), registry.oracle_sql()
    bad = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, SF_DIR)
            rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name:32s} {len(rows):7d} {took:6.1f}s")
                continue
            start = time.time()
            rel = duck.sql(oracles[name])
            cols = sorted(rel.columns)
            expected = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({oracles[name]}) AS q").fetchall()
            duck_took = time.time() - start
            key = lambda r: tuple((v is None, str(v)) for v in r)
            got, want = sorted(rows, key=key), sorted(expected, key=key)
            types = dict(zip(rel.columns, map(str, rel.types)))
            kinds = [(c, t, types[c]) for c, t in df.dtypes if c in types and not same_type(t, types[c])]
            ok = sorted(df.columns) == cols and got == want
            print(f"{'ok   ' if ok else 'BAD  '} {name:32s} {len(rows):7d} {took:6.1f}s duck {duck_took:5.1f}s {kinds or ''}", flush=True)
            if not ok:
                bad.append(name)
                print("   columns", sorted(df.columns), cols, len(got), len(want))
                diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
                for g, w in diff:
                    print("   spark", dict(zip(sorted(df.columns), g)))
                    print("   duck ", dict(zip(cols, w)))
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)
    print("bad:", bad)
    spark.stop()
    return bool(bad)


def same_type(spark_type, duck_type):
    groups = [{"bigint", "BIGINT"}, {"string", "VARCHAR"}, {"double", "DOUBLE"}, {"boolean", "BOOLEAN"}, {"int", "INTEGER"}]
    return any(spark_type in g and duck_type in g for g in groups)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
