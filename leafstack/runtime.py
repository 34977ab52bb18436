"""Session set-up, lineage cuts and size-checked broadcasts."""

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side is used only after its row count was checked against this.
BROADCAST_ROWS = 200_000

# What a Python worker is handed at once; without it a batch has 10,000 rows of whatever length.
BATCH_BYTES = "2m"


def local_session(cores="*", **conf) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName("leafstack")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "12g")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_SHIPPED = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, wherever the driver was started.

    Their batches are bounded by bytes unless the session does that.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent
        target = tempfile.mkdtemp(prefix="leafstack-zip-")
        archive = shutil.make_archive(f"{target}/leafstack", "zip", root_dir=package.parent, base_dir=package.name)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a temporary folder in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="leafstack-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def stage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and cut its lineage.

    Used between fixpoint rounds, and wherever two branches of a plan must see
    the very same physical rows (row numbers handed out by partition).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: readers prune columns and push filters down."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the size check passes; otherwise leave a shuffle join."""
    return F.broadcast(df) if fits(df, rows) else df
