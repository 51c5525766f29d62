"""Session defaults for local runs; a cluster brings its own."""

import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "voxfield", cores: int = 8, shuffle_partitions: int = 8, checkpoint_dir: str = "/tmp/voxfield-checkpoints", memory: str = "8g") -> SparkSession:
    """A local session with UTC times, AQE and Arrow. Only for one machine: the checkpoint folder is local."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", checkpoint_dir)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Without one a local session gets a folder of its own; a cluster
    must name one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="voxfield-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows in this session, unless it asks for fewer: a worker holds a whole batch, and rows of pages are long. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
