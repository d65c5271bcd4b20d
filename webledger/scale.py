"""What the jobs share to stay even under skew and to survive lost executors.

Working tables are written as Parquet under ``spark.checkpoint.dir``, so a lost executor costs a
re-read and no recomputation. Keys with very many rows are found by a counted look at the
data and then salted (joins) or cut into ordered chunks (windows). Null keys are keys like any other
in windows, and rows that match nothing in joins; no row is ever left out.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key with at least this many rows is treated as hot.
HOT_ROWS = 1_000_000
# A whole table is broadcast only when its measured size stays under this.
BROADCAST_BYTES = 64 * 1024 * 1024


def work_dir(spark: SparkSession) -> str:
    """The shared folder for working tables as the session names it, with its file system.

    A path without a scheme is one of the default file system, as Spark's own writers take it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") or "/")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return system.makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="webledger-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a working table and read it back: the plan behind it is done once and cut off."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, name: str, keys: Sequence[str], parts: str | None = None) -> DataFrame:
    """Like :func:`store`, bucketed by ``keys``: later joins on them do not move this side.

    ``df`` should come out of a shuffle on the same keys, so that each bucket is one file; one in each folder of
    the column ``parts``, if one is named: a filter on it leaves whole folders unread.
    """
    spark = df.sparkSession
    table = f"webledger_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if parts is not None:
        writer = writer.partitionBy(parts)
    writer.option("path", f"{work_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """All keys of ``df`` with at least ``hot_rows`` rows, null ones too, as a stored table.

    There are no more of them than rows of ``df`` divided by ``hot_rows``.
    """
    return store(df.groupBy(*keys).count().where(F.col("count") >= hot_rows).select(*keys), "hot")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; the result has the keys once, as in ``left``."""
    other = {k: f"_other_{k}" for k in keys}
    named = right.select(*[F.col(k).alias(other.get(k, k)) for k in right.columns])
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()]
    return left.join(named, same, how).drop(*other.values())


def join_to_one(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str | Column],
    how: str = "left",
    hot: DataFrame | bool | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``many`` to ``one`` (unique by ``keys``) without a hot key filling one task.

    Rows of a hot key are spread over as many tasks as there are shuffle partitions, by a hash of
    the ``spread`` columns, and its single partner row is copied to each of them. Rows with a null
    key, which match nothing, are spread too. ``hot`` may be given as a table of keys, or False when
    the caller knows that there are none; without hot keys this is the ordinary join and Spark picks
    how to do it.
    """
    keys = list(keys)
    if hot is None:
        hot = hot_keys(many, keys, hot_rows)
    if hot is False or hot.isEmpty():
        return many.join(one, keys, how)
    salts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = hot.dropna().withColumn("_hot", F.lit(True))
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    salted_many = many.join(listed, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_hot") | no_key, F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(0).cast("int"),
    )
    salted_one = one.join(listed, keys, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    joined = salted_many.drop("_hot").join(salted_one.drop("_hot"), [*keys, "_salt"], how)
    return joined.drop("_salt")


def join_small(many: DataFrame, one: DataFrame, keys: Sequence[str], spread: Sequence[str | Column], how: str = "left") -> DataFrame:
    """Join to a table that is usually small: broadcast if its measured size allows, else salted."""
    size = F.lit(0)
    for column in one.schema:
        wide = column.dataType.simpleString() in ("string", "binary")
        size = size + (F.coalesce(F.octet_length(column.name), F.lit(0)) + 16 if wide else F.lit(16))
    total = one.agg(F.sum(size.cast("bigint")).alias("n")).first()["n"] or 0
    if total <= BROADCAST_BYTES:
        return many.join(F.broadcast(one), list(keys), how)
    return join_to_one(many, one, keys, spread, how)


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame | None, DataFrame]:
    """(rows of hot keys, or None if there is no such key; all other rows)."""
    hot = hot_keys(df, keys, hot_rows)
    if hot.isEmpty():
        return None, df
    return join_null_safe(df, hot, keys, "left_semi"), join_null_safe(df, hot, keys, "left_anti")


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Cut every key's rows into consecutive, evenly sized chunks and store them.

    The range shuffle balances by row count, whatever the keys; ``_chunk`` numbers its partitions,
    so chunk numbers grow in the order of (keys, order). Stored, because a sampled range shuffle
    may cut elsewhere when it is run a second time.
    """
    cut = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    return store(cut.withColumn("_chunk", F.spark_partition_id()), "chunks")


def with_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """``row_number() over (partition by keys order by order)``, in parallel inside a hot key.

    ``hot_rows=None``: the caller knows that no key is hot.
    """
    keys, order = list(keys), list(order)
    heavy, rest = (None, df) if hot_rows is None else split_hot(df, keys, hot_rows)
    plain = rest.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if heavy is None:
        return plain
    chunks = ordered_chunks(heavy, keys, order)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.groupBy(*keys, "_chunk").count().select(
        *keys, "_chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    numbered = join_null_safe(chunks.withColumn(out, inside), offsets, [*keys, "_chunk"])
    total = (F.col(out) + F.col("_before")).cast(plain.schema[out].dataType)
    return plain.unionByName(numbered.withColumn(out, total).drop("_chunk", "_before"))
