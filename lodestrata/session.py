"""Session helpers: the shared folder, checkpoints and size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes up to which a join side is broadcast after it has been measured.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
#: Salt values by which the large side of a join that cannot broadcast is spread.
SALTS = 16
_made: dict[str, list[str]] = {}


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestrata")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, as --py-files does, so that they can import it wherever the driver began."""
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False):
        return
    root = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp(prefix="spark-lodestrata-")) / "lodestrata.zip"
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    context.addPyFile(str(made))
    context._lodestrata_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a new one of this machine in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-lodestrata-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, until cleared."""
    made = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(made)
    return made


def cleared(spark: SparkSession) -> int:
    """Deletes the folders of this application that fresh_dir gave, when nothing reads their results any more; how many there were.

    Checkpoints are deleted by Spark itself once their DataFrames are gone (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    gone = _made.pop(spark.sparkContext.applicationId, [])
    for folder in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that it is computed once and survives lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of df and about how many bytes they hold: the lengths of strings, binaries and arrays, 16 for anything else."""
    size: Column = F.lit(0)
    for name, kind in df.dtypes:
        one = F.octet_length(name) if kind in ("string", "binary") else F.size(name) * 16 if kind.startswith(("array", "map")) else F.lit(16)
        size = size + F.coalesce(one, F.lit(0))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("b")).first()
    return r.n, r.b


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, salts: int = SALTS, salt_by: str | None = None) -> DataFrame:
    """Join with a right side that is usually small but not proven so.

    The right side is computed once and measured. Up to max_rows rows and BROADCAST_BYTES it is broadcast; beyond that, both
    sides are shuffled, the left side spread over salts by the column salt_by, so that a key with a third of all rows is split.
    """
    right = checkpointed(right)
    n, size = measured(right)
    if n <= max_rows and size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), keys, how)
    return join_salted(left, right, keys, how, salts, salt_by)


def join_salted(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS, salt_by: str | None = None) -> DataFrame:
    """A shuffled join whose left side is spread over salts; right rows are repeated for each salt, so they are never broadcast."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no salted {how} join")
    salt = F.pmod(F.xxhash64(*([salt_by] if salt_by else left.columns)), F.lit(salts))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.withColumn("_salt", salt.cast("bigint")).join(spread.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "seq") -> DataFrame:
    """df with out: the position (from 0) of each row among those with equal keys, by order.

    Rows are range-partitioned by keys and order, numbered inside each partition, and shifted by the sizes of the partitions
    before, so a key with a third of all rows is spread over many tasks. order must settle the position of every row.
    """
    spread = df.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id())
    spread = checkpointed(spread)
    local = Window.partitionBy("_pid", *keys).orderBy(*order)
    sizes = spread.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select(*keys, "_pid", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    same = F.col("a._pid") == F.col("b._pid")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    rows = spread.withColumn("_i", F.row_number().over(local)).alias("a").join(shift.alias("b"), same, "left")
    return rows.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._i") - 1 + F.col("b._before")).cast("bigint").alias(out))


def before(df: DataFrame, key: str, value: Column | str, out: str, order: list[str]) -> DataFrame:
    """df with out: the last value that isn't null in the rows before, by key and order.

    Rows are ordered within parts of a key (the column part, which rises with order); what a part hands on goes through
    one row a part, so a key with a third of all rows is many tasks.
    """
    rows = df.withColumn("_value", F.col(value) if isinstance(value, str) else value)
    inside = Window.partitionBy(key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    handed = rows.groupBy(key, "part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last"))
    parts = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = handed.select(key, "part", F.last("_last", ignorenulls=True).over(parts).alias("_handed"))
    local = rows.withColumn("_local", F.last("_value", ignorenulls=True).over(inside)).drop("_value")
    return local.join(handed, [key, "part"], "left").withColumn(out, F.coalesce("_local", "_handed")).drop("_local", "_handed")
