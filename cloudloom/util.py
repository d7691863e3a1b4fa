"""Small helpers shared by the operators: table loading, lineage cutting, salted joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shards of a salted key. A key that holds a third of all rows is spread over this many tasks.
SALT = 32
#: Tables of ``cut`` that haven't been dropped.
_LEFT: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session that runs on one machine may go without; it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cloudloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read it again.

    The table survives the loss of executors, is compressed, and its true size is known to the planner, which then broadcasts it
    only below its threshold. ``drop`` removes it once nothing reads it any more; what is left goes when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cloudloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _LEFT[path] = spark
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables written by ``cut``, or those that a table made of several names as its ``_cut_parts``."""
    for df in tables:
        drop(*getattr(df, "_cut_parts", ()))
        path = getattr(df, "_cut_path", None)
        if path:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    _LEFT.pop(path, None)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def drop_all() -> None:
    """Remove every table of ``cut`` that is still there. Runs at the end of the process; results read before stay unread after."""
    for path, spark in list(_LEFT.items()):
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001, PERF203  (the session is gone already)
            _LEFT.pop(path, None)


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """Keys that hold more than ``share`` of all rows: at most 1 / ``share`` of them. One partial aggregate; for tables of ``cut``."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in n.where((F.col("n") > share * total) & F.col(key).isNotNull()).select(key).collect()]


def _broadcast(df: DataFrame) -> bool:
    """Whether the planner takes ``df`` for small enough to be broadcast."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salt: int = SALT, hot: list | None = None) -> DataFrame:
    """Equi-join whose hot keys of ``big`` are spread over ``salt`` shards; ``small`` (one row per key) is repeated per shard.

    With ``hot`` (see ``hot_keys``; for a single key) only these keys are spread and repeated, without it all. ``how`` may be inner
    or left. Null keys match nothing, as in any equi-join. A ``small`` that the planner broadcasts anyway goes out as it is: the
    planner takes its repeats for the table's own size and would send them all to the driver.
    """
    if hot is not None or _broadcast(small):
        if not hot:
            return big.join(small, keys, how)
        spread = F.col(keys[0]).isin(hot)
        left = big.withColumn("_salt", F.when(spread, F.pmod(F.xxhash64(*[c for c in big.columns if c not in keys]), F.lit(salt)).cast("int")).otherwise(0))
        right = small.withColumn("_salt", F.explode(F.when(spread, F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))))
        return left.join(right, [*keys, "_salt"], how).drop("_salt")
    plain = [F.col(c) for c, kind in big.dtypes if "map<" not in kind and "array<" not in kind]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salt)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
