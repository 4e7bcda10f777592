"""Writing: upserts, deletes by source, manifests and hash state, on plain Parquet."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``new`` and those of ``old`` whose keys it lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_sources(rows: DataFrame, gone: DataFrame, source: str = "source") -> DataFrame:
    """``rows`` without those of the sources in ``gone``; rows without a source stay."""
    return rows.join(gone.select(source).distinct(), source, "left_anti")


def latest_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def changed(files: DataFrame, state: DataFrame, scope: list[str] = ["path"]) -> DataFrame:  # noqa: B006
    """Files whose hash is new or has changed; unknown hashes count as changed."""
    known = state.select(*scope, F.col("hash").alias("_known"))
    return files.join(known, scope, "left").where(~F.col("hash").eqNullSafe(F.col("_known")) | F.col("_known").isNull()).drop("_known")


def drift(resolved: DataFrame, frozen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one side only, with ``side`` saying which."""
    gone = frozen.join(resolved, keys, "left_anti").select(*keys, F.lit("missing").alias("side"))
    return gone.unionByName(resolved.join(frozen, keys, "left_anti").select(*keys, F.lit("new").alias("side")))


def write_partitioned(rows: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions of ``by`` that ``rows`` have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def discover(spark: SparkSession, folder: str, pattern: str = "*.txt", recursive: bool = True) -> DataFrame:
    """(path, size, hash, content) of files; ``hash`` is the MD5 of the content, in hexadecimal."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.md5("content").alias("hash"), "content")


def read_records(spark: SparkSession, path: str, missing_ok: bool = True) -> DataFrame | None:
    """A JSON array as rows; null if there is no file and that is allowed. What does not parse is an error unless it is allowed."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("mode", "PERMISSIVE" if missing_ok else "FAILFAST").json(path, multiLine=True)
    except AnalysisException as e:
        if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def key_values(text: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, section, field, raw, value, unit) of snapshots with lines ``Label : value`` under ``--- Section ---`` lines."""
    lines = text.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    name = F.regexp_extract("line", r"^-{3}\s*(.*?)\s*-{3}$", 1)
    w = Window.partitionBy(id_col).orderBy("pos")
    marked = lines.withColumn("section", F.last(F.when(name != "", name), ignorenulls=True).over(w))
    pairs = marked.where(F.col("line").rlike(r"^\s*[^:]+?\s*:\s*\S") & ~F.col("line").rlike(r"^-{3}"))
    raw = F.trim(F.regexp_extract("line", r"^[^:]+:\s*(.*)$", 1))
    number = F.regexp_replace(F.regexp_extract(raw, r"^\$?(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")
    unit = F.when(raw.endswith("%"), F.lit("percent")).when(raw.rlike(r"[0-9]T$"), F.lit("T")).when(raw.rlike(r"[0-9]B$"), F.lit("B")).when(raw.rlike(r"[0-9]M$"), F.lit("M"))
    return pairs.select(id_col, "section", F.trim(F.regexp_extract("line", r"^([^:]+):", 1)).alias("field"), raw.alias("raw"), number.alias("value"), unit.alias("unit"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; one is made and set only where it names none, as in tests."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="quarry-")
    sc.setCheckpointDir(named)
    return named
