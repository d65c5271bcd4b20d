"""Compare registered queries with their SQL: ``python tests/check_oracles.py [sf] [name …]``."""

import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as spec  # noqa: E402


def connect(sf: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf).glob("*.parquet")):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def difference(spark, db, name: str, sf: str) -> str | None:
    """What differs between a query and its SQL, or None."""
    got = spec.queries()[name](spark, sf)
    names = sorted(got.columns)
    mine = [tuple(plain(v) for v in row) for row in got.select(*names).collect()]
    twin = db.execute(spec.oracle_sql()[name])
    columns = [d[0] for d in twin.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    order = [columns.index(n) for n in names]
    theirs = [tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in twin.fetchall()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    mine.sort(key=key)
    theirs.sort(key=key)
    if mine == theirs:
        return None
    extra, lacking = list(set(mine) - set(theirs))[:3], list(set(theirs) - set(mine))[:3]
    return f"{len(mine)} rows against {len(theirs)}; only here {extra}; only there {lacking}"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(spec.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="webledger-check-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="webledger-wh-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf)
    failed = 0
    for name in chosen:
        started = time.time()
        try:
            found = difference(spark, db, name, sf)
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += found is not None
        print(f"CHECK {name}: {'same' if found is None else found} ({time.time() - started:.1f}s)", flush=True)
    print(f"CHECK {len(chosen) - failed} of {len(chosen)} same")
