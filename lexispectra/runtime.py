"""What every stage needs from the session: a shared folder and a sane split."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_DIR_KEY = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as the session names it.

    A local-mode session without one gets a temporary folder; on a cluster a
    machine-local folder would lose tables together with an executor, so there
    the setting is required.
    """
    context = spark.sparkContext
    root = spark.conf.get(_DIR_KEY, None) or context.getConf().get(_DIR_KEY) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {_DIR_KEY} to a folder that all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="lexispectra-")
    return _local_roots[context.applicationId]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read and not a recount
    of the corpus, and gives Catalyst real file sizes to plan with.
    """
    return read_staged(df.sparkSession, df.schema, [write_staged(df, name)])


def write_staged(df: DataFrame, name: str) -> str:
    path = f"{stage_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def read_staged(spark: SparkSession, schema: StructType | str, paths: list[str]) -> DataFrame:
    """One scan over one or more staged tables of the same schema."""
    return spark.read.schema(schema).parquet(*paths)


def drop_staged(df: DataFrame) -> None:
    """Delete the staged tables that ``df`` reads; only for tables nothing else will read."""
    spark = df.sparkSession
    root = stage_root(spark).split("://")[-1].removeprefix("file:")
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if folder.rsplit("/", 1)[0].endswith(root):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_outputs(spark: SparkSession, paths: list[str | None], overwrite: bool) -> None:
    """Refuse outputs that exist, before any work; with ``overwrite`` remove them."""
    for name in filter(None, paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(path):
            if not overwrite:
                raise FileExistsError(f"{name} exists already")
            store.delete(path, True)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop-style path or a plain absolute one, for the driver and the tasks alike."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.FileSystem.from_uri("/" + (rest if colon else path).lstrip("/"))
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one split per core.

    A corpus of real size has more splits than cores and passes unchanged. Use
    on plain scans only: counting the splits of a plan with shuffles runs them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
