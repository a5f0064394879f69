"""Shared helpers: the shared work folder, staged tables and word expressions."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words is space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process, as in tests, a
    temporary folder is made, one for each application.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="accesslens-")
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()  # a folder without a scheme is one of the default file system
    return re.sub("^file:/(?!/)", "file:///", whole).rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder of this run under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: later stages reread the files, whichever executors
    are lost meanwhile.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a written table of keys that may be broadcast; beyond that it is joined by shuffle.
MOST_BROADCAST = 1_000_000


def small_or_shuffled(keys: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``keys`` (a written table of short rows) to be broadcast if its counted rows are few, as it is otherwise."""
    return F.broadcast(keys) if keys.count() <= most else keys


def drop_staged(*frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Return memory that this process has freed to the system; Python workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame, name: str) -> Column:
    """All columns of ``docs``, whatever their names, as one struct."""
    return F.struct(*(quoted(c).alias(c) for c in docs.columns)).alias(name)


class Carried:
    """A user's columns on their way through an operator: one struct, whose fields meet no internal name.

    Columns named like the results, in either case, are left out.
    """

    def __init__(self, docs: DataFrame, keep: list[str] | None, results: list[str]):
        taken = {r.lower() for r in results}
        self.names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
        cells = [quoted(n).alias(n) for n in self.names]
        self.column = F.struct(*(cells or [F.lit(True).alias("none")])).alias("carried")
        self.type = docs.select(self.column).schema["carried"].dataType

    def fields(self) -> list[Column]:
        """The columns themselves, from rows that hold ``carried``."""
        return [F.col("carried").getField(n).alias(n) for n in self.names]

    def schema(self, more: str) -> T.StructType:
        """``carried`` and the columns of a schema in words."""
        return T.StructType([T.StructField("carried", self.type), *T.StructType.fromDDL(more).fields])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words of a non-null text, as a long.

    Splitting at white space leaves an empty piece where the text starts or
    ends with it; those are taken off.
    """
    pieces = F.size(F.split(text, SPACE + "+", -1))
    edges = text.rlike("^" + SPACE).cast("int") + text.rlike(SPACE + "\\z").cast("int")
    return F.when(text == "", 0).otherwise(pieces - edges).cast("long")


def words_of(text: Column) -> Column:
    """The words of a non-null text, in order."""
    return F.array_remove(F.split(text, SPACE + "+", -1), "")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
