"""What a session needs before operators run on it: the package on the executors and a shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="depthlane-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "depthlane.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Only where the session names none, as in local tests, a temporary folder is set as the checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="depthlane-scratch-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    release(spark)
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a materialised DataFrame that nothing will read again."""
    if path := getattr(df, "_scratch", None):
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of rasters or outlines that a task holds as Python objects at a time.
FEW = 32


def map_few(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with few rows at a time in either direction: as Python objects, an Arrow batch of rasters or nested rows
    takes many times its bytes. run maps an iterator of lists of rows, with columns as attributes, to lists of tuples."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches):
        few = ([SimpleNamespace(**r) for r in b.slice(a, FEW).to_pylist()] for b in batches for a in range(0, b.num_rows, FEW))
        for rows in run(few):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return df.mapInArrow(each, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and broadcasts of plans that are done with: it does so only once the driver's
    collectors have found their owners, which on a heap with room to grow may be long after. What the driver's two processes
    have freed then goes back to the system."""
    gc.collect()
    spark._jvm.java.lang.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Return the freed native memory of the driver's Python and JVM: the C library keeps it for each of the hundreds of threads
    that have planned, compiled and sent something. False where either has no such call; nothing depends on it."""
    own = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if own:
        own(0)
    lang, gateway = spark._jvm.java.lang, spark.sparkContext._gateway
    place = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = lang.management.ManagementFactory.getPlatformMBeanServer()
    # the server's class is internal, so its method is called as its interface's
    call = next(m for m in lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = gateway.new_array(lang.Object, 4)
    given[0], given[1] = place, "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):  # a JVM before 17.0.9 or on another C library
        call.invoke(server, given)
        return bool(own)
    return False
