"""What the operators of this subpackage share: the shared folder, tables written there, and reading documents."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, and tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("vigilis.shared.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("vigilis.shared.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vigilis/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing needs any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/vigilis/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_text(col) -> F.Column:
    """Unsigned crc32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(col, F.lit("")))


def fold_of(doc_id, k: int) -> F.Column:
    """crc32(doc_id as text) mod ``k``; a null id is in no held-out fold and gives null."""
    return F.crc32(doc_id.cast("string")) % F.lit(k)


def as_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` as one struct column: whatever its columns are called, none clashes with those that an operator adds."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def from_rows(df: DataFrame, columns: Iterable[str], name: str = "row", **new: Column) -> DataFrame:
    """The ``columns`` of the struct ``name`` and the ``new`` ones, which replace those of the same names."""
    kept = [F.col(f"{name}.`{c}`").alias(c) for c in columns if c not in new]
    return df.select(*kept, *[v.alias(k) for k, v in new.items()])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it where ``df`` has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def need(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}; there are {df.columns}")


_shipped: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if spark.conf.get(BATCH) == "10000":  # Spark's own default; whole texts are long, and workers hold a batch in full
        spark.conf.set(BATCH, "200")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    root = Path(__file__).resolve().parents[2]
    out = Path(tempfile.mkdtemp(prefix="spark-")) / "vigilis.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "vigilis").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(out))
