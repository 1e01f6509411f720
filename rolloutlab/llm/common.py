"""Spark helpers shared by the corpus operators."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloutlab.session import checkpoint_dir
from rolloutlab.sources.tables import SCHEMAS, table_path


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RELEASE_S = 1.2        # Py4J passes dead references on once a second


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan of one input table with its fixed schema."""
    df = spark.read.schema(SCHEMAS[name]).parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts the lineage like a checkpoint: later readers do not repeat the
    work, and a lost executor only costs a reread. With ``tidy`` Spark removes
    the shuffle files of the write when it ends, whatever the driver's garbage."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    try:
        spark.conf.set(SHUFFLE_CLEANUP, "true" if tidy else before)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` once everything read from them is written itself.

    Spark removes the shuffle files of finished jobs when the driver collects its garbage; that is asked for here."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def shuffles_freed(spark: SparkSession) -> None:
    """Have the shuffle files of the jobs so far removed, also the last one's: the driver's JVM hears of tables that
    Python let go with a delay, and takes them for garbage only then."""
    time.sleep(RELEASE_S)
    spark._jvm.System.gc()


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, so other columns of any name cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shuffle_width(spark: SparkSession, factor: int = 1) -> int:
    """The session's shuffle width (the operator's own layouts follow it)."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * factor


def components(edges: DataFrame, label: str = "components", tidy: bool = False) -> DataFrame:
    """Connected components of the undirected edges (a, b).

    Returns (id, component) for every id on an edge; the component is its
    smallest id. Alternates large-star and small-star (Kiveris et al. 2014),
    each an aggregate and a join, until nothing changes; state is a written
    table, so a lost executor repeats one round at most. A hub is never
    gathered: its smallest neighbour is a pre-aggregated minimum."""
    spark = edges.sparkSession
    dtype = edges.schema["a"].dataType
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stored(e, label, tidy)
    n = e.count()
    if n == 0:
        dropped(e)
        return spark.createDataFrame([], T.StructType([T.StructField("id", dtype), T.StructField("component", dtype)]))
    seen = None
    while True:
        # large-star: link every larger neighbour of u to the smallest of u and its neighbours
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small-star: link u and its smaller neighbours to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        older, e = e, stored(small, label, tidy)
        dropped(older)
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    members = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionAll(roots)
