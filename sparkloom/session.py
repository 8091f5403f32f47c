"""Give the executors this package, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application, as a zip that Spark serves."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="sparkloom-zip-")) / "sparkloom.zip"
        with zipfile.ZipFile(target, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, str(path.relative_to(root.parent)))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def spread(df, *keys):
    """df dealt by its keys to eight parts a core: groups that a kernel works on run side by side.

    The number is given because adaptive execution would pack a small input into one task, however long its groups take.
    """
    return df.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def materialize(df):
    """Write to the folder that driver and executors share and read again: what an iteration stands on."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _folders:
            _folders[app] = tempfile.mkdtemp(prefix="sparkloom-")
            atexit.register(shutil.rmtree, _folders[app], True)
        folder = f"file://{_folders[app]}"
    path, schema = f"{folder.rstrip('/')}/sparkloom/{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)
