"""Sources and sinks of the training-data jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SAMPLE_SCHEMA = T.StructType([
    T.StructField("ops", T.StringType(), True),
    T.StructField("data_source", T.StringType(), True),
    T.StructField("code", T.StringType(), True),
])
MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()),
                                     T.StructField("content", T.StringType())]))


def read_samples(spark: SparkSession, path: str, schema: T.StructType = SAMPLE_SCHEMA,
                 rename: dict[str, str] | None = None) -> DataFrame:
    """Parquet scan of raw samples with a fixed schema (no inference).

    ``rename`` maps the file's column names onto ``ops``/``data_source``/``code``
    for files laid out differently; only the named columns are read."""
    if rename:
        df = spark.read.schema(", ".join(f"{src} {t}" for src, t in rename_types(schema, rename).items()))
        return df.parquet(path).select(*[F.col(src).alias(dst) for src, dst in rename.items()])
    return spark.read.schema(schema).parquet(path)


def rename_types(schema: T.StructType, rename: dict[str, str]) -> dict[str, str]:
    """DDL types for the source columns of ``rename``: the target field's type,
    or ``bigint`` for an id column that is not part of the sample schema."""
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    return {src: types.get(dst, "bigint") for src, dst in rename.items()}


def parse_chat(df: DataFrame, col: str = "prompt") -> DataFrame:
    """S2 (parse step): JSON chat text -> ``array<struct<role,content>>`` as ``messages``."""
    return df.withColumn("messages", F.from_json(F.col(col), MESSAGES))


def read_chat(spark: SparkSession, path: str, col: str = "prompt", keep: tuple[str, ...] = ()) -> DataFrame:
    """Read only the chat column (plus ``keep``; column pruning reaches the
    scan) and parse it into ``messages``."""
    return parse_chat(spark.read.parquet(path).select(*keep, col), col).select(*keep, "messages")


def write_split(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """S3: one parquet set per split value (``split=train/``, ``split=val/``).

    Works for an empty split (no rows -> no folder). Writes go through Spark's
    commit protocol, so a lost executor's partial files are never published."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def quarantine(df: DataFrame, predicate: Column, path: str, run_id: str = "run") -> DataFrame:
    """Write rows failing ``predicate`` (null counts as failing) to the side table ``path`` and return those that pass.

    The write is a job of its own. It is idempotent: a run's rows are a partition of its own, which a repeated run
    overwrites, and the run stands in the ledger only when its rows are whole; ``quarantined`` reads runs of the
    ledger. The returned DataFrame stays lazy."""
    spark = df.sparkSession
    ok = F.coalesce(predicate, F.lit(False))
    df.where(~ok).write.mode("overwrite").parquet(f"{path}/rows/run_id={run_id}")
    n = spark.read.schema(df.schema).parquet(f"{path}/rows/run_id={run_id}").count()
    spark.createDataFrame([(run_id, n)], "run_id string, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/run={run_id}")
    return df.where(ok)


def quarantined(spark: SparkSession, path: str, schema) -> DataFrame:
    """The side table's rows of all runs in the ledger, with their ``run_id``."""
    runs = spark.read.schema("run_id string, n long").option("recursiveFileLookup", "true").parquet(f"{path}/ledger")
    fields = T.StructType([*(T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields, T.StructField("run_id", T.StringType())])
    rows = spark.read.schema(fields).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(runs.select("run_id"), "run_id", "left_semi").select(*fields.names)


def keep_latest(df: DataFrame, keys: list[str], order: str | Column, n: int = 3) -> DataFrame:
    """Newest ``n`` rows per group. ``row_number() <= n`` plans as a
    ``WindowGroupLimit``: each map task keeps only its top ``n`` per key before
    the shuffle, so a hot key sends at most ``n`` rows per task."""
    o = F.col(order) if isinstance(order, str) else order
    w = Window.partitionBy(*keys).orderBy(o.desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
