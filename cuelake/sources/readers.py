"""Readers with explicit schemas."""

from __future__ import annotations

import io
import json
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuelake.schemas import DOCUMENT, EVAL_RECORD, MANIFEST, WEB_METADATA


def documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of documents; a malformed line fails the read."""
    return spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)


def previous_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of an earlier run: blank and malformed lines skipped, the last row of an id wins."""
    rows = spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").json(path).where("id is not null").withColumn("__i", F.monotonically_increasing_id())
    return rows.withColumn("__r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("__i")))).where("__r = 1").drop("__i", "__r")


def web_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of articles, one JSON file each, named by hash; corrupt ones are left out."""
    rows = spark.read.schema(WEB_METADATA.replace("video_hash STRING, ", "") + ", _corrupt_record STRING").option("multiLine", True).json(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return rows.select(name.alias("video_hash"), "*").where("_corrupt_record is null").drop("_corrupt_record")


def video_hashes(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("video_hash")).distinct()


def zip_export(spark: SparkSession, path: str) -> DataFrame:
    """Articles of ZIP archives of JSON entries, objects or lists of them; bad entries are skipped. Adds the raw JSON."""

    def entries(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for content in batch.content:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        try:
                            found = json.loads(z.read(name))
                        except ValueError:
                            continue
                        out += [json.dumps(x) for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]
            yield pd.DataFrame({"raw": out})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(entries, "raw STRING").select("raw", F.from_json("raw", WEB_METADATA).alias("a")).select("a.*", "raw")


def eval_set(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return spark.read.schema(EVAL_RECORD).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest table; an empty one where there is none, which makes a run a full one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(path)


def sheet_column(spark: SparkSession, path: str, letters: str, first_row: int = 1) -> DataFrame:
    """row (from one) and value of a CSV column by its letters; blanks are skipped. A sheet is one file."""
    from cuelake.functions.text import column_index

    i = spark.range(1).select(column_index(F.lit(letters))).first()[0]
    lines = spark.read.csv(path, header=False).select(F.monotonically_increasing_id().alias("__i"), F.trim(F.col(f"_c{i}")).alias("value"))
    numbered = lines.withColumn("row", F.row_number().over(W.orderBy("__i"))).where(F.col("row") >= first_row)
    return numbered.where("coalesce(value, '') <> ''").select("row", "value")


def runs(*tables: DataFrame, top_k: int | None = None, axis: str | None = None) -> DataFrame:
    """Experiment runs of several tables, missing columns null, by top_k and sweep axis."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    out = out if top_k is None else out.where(F.col("top_k") == top_k)
    return out if axis is None else out.where(F.col("axis") == axis)


def setting(name: str, default: str | None = None) -> str | None:
    """A secret: the file that NAME_FILE names, else NAME, else the default. Driver only."""
    file = os.environ.get(f"{name}_FILE")
    if file:
        with open(file, encoding="utf-8") as f:
            return f.read().strip()
    return os.environ.get(name) or default
