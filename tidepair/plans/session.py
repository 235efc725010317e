"""Session helpers: size limits and lineage cuts."""

import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

HOT_ROWS = "spark.tidepair.hotGroupRows"
BROADCAST_ROWS = "spark.tidepair.broadcastRows"


def hot_rows(spark: SparkSession) -> int:
    """Rows one window group may hold before it is split over several tasks."""
    return int(spark.conf.get(HOT_ROWS, "4000000"))


def broadcast_rows(spark: SparkSession) -> int:
    """Proven row bound up to which a side is broadcast explicitly."""
    return int(spark.conf.get(BROADCAST_ROWS, "200000"))


_LOCAL: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def cut(df: DataFrame, **options) -> DataFrame:
    """Cut the lineage: write the rows once as a Parquet table in the shared folder and read them back.

    Columnar files are smaller than serialised rows, keep column pruning, and survive lost executors. `options`: of the writer.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(), and how many rows it wrote: counted while they are written, without a job of its own."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, int(seen.get.get("n", 0))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application (needed by the Arrow functions)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = pathlib.Path(__file__).resolve().parents[2]
        target = pathlib.Path(tempfile.mkdtemp(prefix="spark-")) / "tidepair"
        spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", root, "tidepair"))
        _SHIPPED.add(app)
