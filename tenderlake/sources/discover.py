"""Package folders as rows of files, good and rejected."""

from __future__ import annotations

import hashlib
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import file_stem_id

#: Files above so many bytes are rejected unread.
MOST_BYTES = 250 * 1024 * 1024
KINDS = {"pdf": "pdf", "docx": "docx"}
# What rejected files are told.
OUTSIDE, UNREADABLE, UNSUPPORTED = "outside package directory: ", "unreadable file: ", "unsupported file type: "
LEGACY = ".doc legacy Word not supported — convert to .docx and re-upload"


def listing(spark: SparkSession, package_dir: str) -> DataFrame:
    """(path, length, filename, outside) of every file below a folder, names that start with a dot or an underscore too.

    Listed through the folder's own file system; only names and sizes are on the driver, as
    in any listing. A local file whose real path lies elsewhere is outside.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(package_dir)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = system.makeQualified(where).toString().rstrip("/")
    found, rows = system.listFiles(where, True), []
    while found.hasNext():
        status = found.next()
        path = status.getPath().toString()
        rows.append((path, status.getLen(), path[len(root) + 1 :], _leads_out(path, root)))
    return spark.createDataFrame(rows, "path string, length long, filename string, outside boolean")


def local_path(path: str) -> str | None:
    """The plain name of a file on a mounted file system, else null."""
    return re.sub("^file:/+", "/", path) if path.startswith("file:") else None


def _leads_out(path: str, root: str) -> bool:
    inner, outer = local_path(path), local_path(root)
    if inner is None or outer is None:
        return False
    try:
        return os.path.commonpath([os.path.realpath(inner, strict=True), os.path.realpath(outer)]) != os.path.realpath(outer)
    except OSError:  # where its real place can't be told it counts as outside
        return True


HASHED = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("error", T.StringType())])


@pandas_udf(HASHED)
def _hashed(paths: pd.Series) -> pd.DataFrame:
    """Digest of local files, read piece by piece; or what the file system says."""
    rows = []
    for path in paths:
        try:
            with open(local_path(path), "rb") as f:
                rows.append((hashlib.file_digest(f, "sha256").hexdigest(), None))
        except OSError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["sha256", "error"])


def with_hashes(spark: SparkSession, rows: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """rows with sha256 and read_error; only files inside the folder and within the cap are read, on the executors."""
    wanted = (F.col("length") <= most_bytes) & ~F.col("outside")
    mounted = F.col("path").startswith("file:")
    local = rows.where(wanted & mounted).withColumn("_h", _hashed("path")).select("path", "_h.sha256", F.col("_h.error").alias("read_error"))
    remote = [r.path for r in rows.where(wanted & ~mounted & (F.col("length") > 0)).select("path").collect()]
    hashed = local
    if remote:
        content = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(remote)
        hashed = hashed.unionByName(content.select("path", F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("read_error")))
    out = rows.join(hashed, "path", "left")
    empty = F.when(wanted & (F.col("length") == 0) & F.col("read_error").isNull(), F.sha2(F.lit(b""), 256))
    return out.withColumn("sha256", F.coalesce("sha256", empty))


def identified(rows: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """rows (path, filename, length, outside, sha256, read_error) as files: file_id, filename, sha256, file_type, kind, parse_status, error, path, length.

    A file that was to be read and has no digest is unreadable. Rejected files that were
    not read have zeros for the digest in their id.
    """
    last = F.element_at(F.split("filename", "/"), -1)
    suffix = F.lower(F.regexp_extract(last, r"(?<=.)(\.[^.]*)$", 1))
    stem = F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")
    kind = F.lit(None).cast("string")
    for end, k in KINDS.items():
        kind = F.when(suffix == f".{end}", k).otherwise(kind)
    out_of = F.coalesce("outside", F.lit(False))
    big = ~out_of & (F.col("length") > most_bytes)
    lost = ~out_of & ~big & F.col("sha256").isNull()
    unread = out_of | big | lost
    error = (
        F.when(out_of, F.concat(F.lit(OUTSIDE), F.col("filename"), F.lit(" resolves outside the package")))
        .when(big, F.concat(F.lit("file size "), F.col("length").cast("string"), F.lit(f" bytes exceeds cap of {most_bytes} bytes")))
        .when(lost, F.concat(F.lit(UNREADABLE), F.coalesce("read_error", F.lit("it can't be read"))))
        .when(suffix == ".doc", LEGACY)
        .when(kind.isNull(), F.concat(F.lit(UNSUPPORTED), F.coalesce(F.nullif(suffix, F.lit("")), F.lit("(no extension)"))))
    )
    prefix = F.when(unread, "0" * 12).otherwise(F.substring("sha256", 1, 12))
    rejected = error.isNotNull()
    return rows.select(
        F.concat_ws("-", prefix, file_stem_id(stem)).alias("file_id"),
        "filename",
        F.when(unread, "").otherwise(F.col("sha256")).alias("sha256"),
        F.when(big, F.coalesce(kind, F.lit("other"))).when(rejected, "other").otherwise(kind).alias("file_type"),
        F.when(rejected, "rejected").otherwise(kind).alias("kind"),
        F.when(rejected, "rejected").alias("parse_status"),
        error.alias("error"),
        "path",
        "length",
    )


def discover(spark: SparkSession, package_dir: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per file of a folder, in path order; whatever a file does, it is a row."""
    return identified(with_hashes(spark, listing(spark, package_dir), most_bytes), most_bytes).orderBy("filename")
