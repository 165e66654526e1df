"""Session plumbing shared by every operator that needs files or Python on the executors."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
#: Workspaces of this application.
_OPEN: list[Workspace] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests), a temporary folder becomes the checkpoint folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not configured:
        configured = context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="cadastra-checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def local_path(spark: SparkSession, name: str) -> str | None:
    """``name`` as a path of the machines' own (shared) file system; None if it lies in another store.

    Without Hadoop's native library its local file system starts two processes for each file that it makes, some 10 ms.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    scheme = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    return path.toUri().getPath() if scheme == "file" else None


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that functions pickled by name load there.

    The archive goes to the shared folder, under a name that its content gives.
    """
    context = spark.sparkContext
    if getattr(context, "_cadastra_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.writestr(zipfile.ZipInfo(source.relative_to(_PACKAGE.parent).as_posix()), source.read_bytes())
    name = f"{shared_dir(spark)}/cadastra-{hashlib.sha256(packed.getvalue()).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(name)
    context._cadastra_shipped = True


class Workspace:
    """Tables written to a private folder under the shared one.

    A saved table cuts lineage as a checkpoint does: it survives the loss of any executor, and it is columnar and
    compressed. ``drop`` frees what no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.tables: set[str] = set()
        _OPEN.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def _table(self, name: str) -> str:
        return f"`{re.sub(r'[^0-9a-z]', '_', self.root.rsplit('/', 1)[-1].lower())}_{name}`"

    def save_buckets(self, df: DataFrame, name: str, buckets: int, keys: list[str]) -> DataFrame:
        """``df`` as a table bucketed and sorted by ``keys``: joins and groups on them need no exchange."""
        self.tables.add(name)
        df.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", self.path(name)).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(self._table(name))
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
                self.tables.discard(name)
            _delete(self.spark, self.path(name))

    def close(self) -> None:
        """Removes the folder. What was not collected or written yet can't be read any more."""
        self.drop(*self.tables)
        _delete(self.spark, self.root)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _close_all() -> None:
    """Results are read from their workspaces until the application ends; what it leaves then is nobody's."""
    for workspace in list(_OPEN):
        with contextlib.suppress(Exception):  # the session is stopped: its files can't be reached from here
            if workspace.spark.sparkContext._jsc is not None:
                workspace.close()


atexit.register(_close_all)


def one_of(columns: list[str], wanted: str) -> str:
    """A column name that does not clash with ``columns``."""
    while wanted in columns:
        wanted = f"_{wanted}"
    return wanted
