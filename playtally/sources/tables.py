"""Reading and writing the engine's tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from playtally.sources.schemas import schema

# Column each large table is partitioned by on disk, so that date filters
# prune directories instead of reading rows.
PARTITION_COLUMN = {
    "raw_events": "event_datekey",
    "merged_events": "event_datekey",
    "summary_daily": "event_date",
    "summary_weekly": "event_date",
    "summary_monthly": "event_date",
    "event_summary_daily": "event_date",
    "event_summary_weekly": "event_date",
    "event_summary_monthly": "event_date",
    "event_assets": "event_date",
}


JDBC_PARTITION_OPTIONS = ["partitionColumn", "lowerBound", "upperBound", "numPartitions"]


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Parquet table below ``root``, with its declared schema."""
    return spark.read.schema(schema(table)).parquet(f"{root}/{table}")


def read_jdbc(
    spark: SparkSession, table: str, url: str, single_task: bool = False, **options: str
) -> DataFrame:
    """Table that still lives in a warehouse.

    Needs ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions``; a small table may be read by a single task instead.
    """
    missing = [name for name in JDBC_PARTITION_OPTIONS if name not in options]
    if missing and not single_task:
        raise ValueError(f"one task would read all of {table}; {', '.join(missing)} missing")
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_table(
    df: DataFrame,
    path: str,
    partition_column: str | Sequence[str] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write parquet, partitioned on disk by one or more columns.

    The rebalance hint gathers a partition value into few files, and lets
    adaptive execution split a value that holds too many rows for one task.
    ``mode='overwrite'`` replaces only the partitions present in ``df``.
    """
    if partition_column is None:
        df.write.mode(mode).parquet(path)
        return
    columns = _columns(partition_column)
    (
        df.hint("rebalance", *columns)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .parquet(path)
    )


def replace_partitions(
    df: DataFrame,
    path: str,
    partition_column: str | Sequence[str],
    is_replaced: Callable[[str], bool],
) -> None:
    """Write ``df``; partitions to be replaced for which it has no rows go.

    ``is_replaced`` gets the value of a partition, of its last column, as text. A partition that
    was written anew has other files than before; what still has old ones got no rows.
    Only names are read for that, and a repeated run ends in the same state.
    """
    spark = df.sparkSession
    before = _partition_files(spark, path, partition_column)
    write_table(df, path, partition_column, mode="overwrite")
    after = _partition_files(spark, path, partition_column)
    for folder, files in before.items():
        if is_replaced(folder.rsplit("=", 1)[1]) and files & after.get(folder, set()):
            gone = spark._jvm.org.apache.hadoop.fs.Path(folder)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def _partition_files(
    spark: SparkSession, path: str, partition_column: str | Sequence[str]
) -> dict[str, set[str]]:
    """File names of each partition folder; none where the table does not exist."""
    folders = "/".join(f"{column}=*" for column in _columns(partition_column))
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folders}/*.parquet")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    files: dict[str, set[str]] = {}
    for status in found or []:
        files.setdefault(status.getPath().getParent().toString(), set()).add(
            status.getPath().getName()
        )
    return files


def partition_values(spark: SparkSession, path: str, columns: Sequence[str]) -> set[str]:
    """Values of the last partition column that the table has files for; only names are read."""
    return {folder.rsplit("=", 1)[1] for folder in _partition_files(spark, path, columns)}


def _columns(partition_column: str | Sequence[str]) -> list[str]:
    return [partition_column] if isinstance(partition_column, str) else list(partition_column)


def create_view(df: DataFrame, name: str) -> None:
    """Publish a frame under a name for SQL readers of the session."""
    df.createOrReplaceTempView(name)
