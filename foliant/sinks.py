"""Writing: free names for outputs, one text file per document, audit records."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators.resume import exists
from .sources.files import file_system


def output_name(rel_path: Column, suffix: str) -> Column:
    """A relative path with its last extension replaced, or the suffix added where there is none."""
    return F.concat(F.regexp_replace(rel_path, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def unique_names(df: DataFrame, target: str, order: list[str], taken: DataFrame | None = None) -> DataFrame:
    """Adds name: the target for its first row, then "x_2.ext", "x_3.ext" and so on, past names already taken.

    taken: one column of existing names.  Numbers are given in one window over the target, in the given order.
    """
    stem, suffix = F.regexp_extract(target, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(target, r"^(.*?)(\.[^./]*)?$", 2)
    number = F.row_number().over(W.partitionBy(target).orderBy(*order))
    df = df.withColumn("_k", number)
    if taken is not None:
        held = taken.select(F.col(taken.columns[0]).alias("_name"))
        base, ext = F.regexp_extract("_name", r"^(.*?)(?:_(\d+))?(\.[^./]*)?$", 1), F.regexp_extract("_name", r"^(.*?)(?:_(\d+))?(\.[^./]*)?$", 3)
        at = F.coalesce(F.expr(r"try_cast(regexp_extract(_name, '^(.*?)(?:_(\\d+))?(\\.[^./]*)?$', 2) AS INT)"), F.lit(1))
        last = held.select(F.concat(base, ext).alias(target), at.alias("_at")).groupBy(target).agg(F.max("_at").alias("_last"))
        df = df.join(last, target, "left").withColumn("_k", F.col("_k") + F.coalesce("_last", F.lit(0))).drop("_last")
    return df.withColumn("name", F.when(F.col("_k") == 1, F.col(target)).otherwise(F.concat(stem, F.lit("_"), F.col("_k").cast("string"), suffix))).drop("_k")


def relative(path: Column, root: str | None) -> Column:
    """A path below the root folder without it; the name alone of one that is not below it, or is the root itself."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    if not root:
        return name
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    top = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root).rstrip("/") + "/"
    return F.when(F.startswith(bare, F.lit(top)), F.substr(bare, F.lit(len(top) + 1))).otherwise(name)


def audit_name(rel_path: Column) -> Column:
    """Where a file's page records go: its relative path with _paginas.jsonl for its extension."""
    return output_name(rel_path, "_paginas.jsonl")


def taken_names(spark: SparkSession, folder: str) -> DataFrame | None:
    """Relative paths of the files in a folder; None where there is no folder."""
    if not exists(spark, folder):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return files.select(relative(F.col("path"), root).alias("name"))


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_files(lines: DataFrame, folder: str, order: list[str], text: str = "body") -> None:
    """One file per target below folder: its rows' texts in order, put in place whole once they are written.

    A task writes many files, and a file row by row as the sorted rows come, so no document is held in memory.  Every file
    is written by one task; inputs of very many or very large documents are better written packed.
    """

    def run(batches):
        import pyarrow as pa

        fs, base = file_system(folder)
        now, at, handle, n = None, "", None, 0

        def close() -> int:
            if handle is None:
                return 0
            handle.close()
            fs.move(at, f"{base}/{now}")
            return 1

        for b in batches:
            for target, body in zip(b.column("target").to_pylist(), b.column(text).to_pylist(), strict=True):
                if target != now:
                    n += close()
                    now = target
                    parent, _, name = f"{base}/{target}".rpartition("/")
                    fs.create_dir(parent, recursive=True)
                    at = f"{parent}/.{name}.{uuid.uuid4().hex}.tmp"
                    handle = fs.open_output_stream(at)
                handle.write(body.encode())
        n += close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    rows = lines.select("target", *order, text).repartition("target").sortWithinPartitions("target", *order)
    rows.mapInArrow(run, "files bigint").agg(F.sum("files")).collect()


def write_packed(sections: DataFrame, path: str) -> None:
    """All documents in few files, in the order of (file_id, part, page), as text; an index beside says where each begins.

    Range partitions follow (file_id, part, page), so no task holds more than its share of a large document.
    """
    ordered = sections.repartitionByRange("file_id", "part", "page").sortWithinPartitions("file_id", "part", "page")
    ordered.select("file_id", "part", "page", "body").write.mode("overwrite").parquet(path)


def write_audit_files(records: DataFrame, folder: str) -> None:
    """One line of JSON per page, a file of them per target; keys in their fixed order, nulls written."""
    fields = [c for c in records.columns if c != "target"]
    line = F.concat(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.lit("\n"))
    write_files(records.select("target", "page", line.alias("body")), folder, ["page"])


def write_audit(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
