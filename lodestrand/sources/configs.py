"""Reading configurations, captures and records from files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import ship

ARTIFACT = "config_id string, component string, name string, content string"


def json_file(spark: SparkSession, path: str) -> DataFrame:
    """(name, content): whole JSON files as raw text; nothing is parsed, so nothing is lost."""
    ship(spark)
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("content"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(content,): the lines of JSONL files that aren't blank, trimmed."""
    return spark.read.text(path).select(F.trim("value", F.lit(" \t\r\n\x0b\x0c")).alias("content")).filter("content <> ''")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files right under a folder."""
    return json_file(spark, path)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def configuration(spark: SparkSession, folder: str, config_id: str) -> DataFrame:
    """The artifacts of one configuration folder, on any file system that Spark reads: agent.json must be there, all else may be absent.

    Files of the corpus whose names begin with ``_`` or ``.`` are left out, as Spark leaves them out everywhere.
    """
    if not _exists(spark, f"{folder}/agent.json"):
        raise FileNotFoundError(f"{folder} has no agent.json")
    parts = [json_file(spark, f"{folder}/agent.json").select(F.lit("agent").alias("component"), "name", "content")]
    for file, component in (("prompt.txt", "prompt"), ("procedure.md", "procedure")):
        if _exists(spark, f"{folder}/{file}"):
            parts.append(text_files(spark, f"{folder}/{file}").select(F.lit(component).alias("component"), "name", "content"))
    if _exists(spark, f"{folder}/tools.json"):
        parts.append(_tools(json_file(spark, f"{folder}/tools.json")))
    if _exists(spark, f"{folder}/corpus/[!._]*"):
        parts.append(text_files(spark, f"{folder}/corpus/[!._]*").select(F.lit("corpus").alias("component"), "name", "content"))
    if _exists(spark, f"{folder}/eval.jsonl"):
        parts.append(json_lines(spark, f"{folder}/eval.jsonl").select(F.lit("eval_item").alias("component"), F.coalesce(F.get_json_object("content", "$.id"), F.lit("")).alias("name"), "content"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(config_id).alias("config_id"), "component", "name", "content")


def _tools(document: DataFrame) -> DataFrame:
    """A row per tool with its raw text, and the document itself if it is an object."""
    import pandas as pd

    from lodestrand.functions.rawjson import list_items

    def split(batches):
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                items, is_object = list_items(content, "tools")
                rows += [("tool", "", item) for item in items]
                if is_object:
                    rows.append(("tools_document", "", content))
            yield pd.DataFrame(rows, columns=["component", "name", "content"])

    return document.mapInPandas(split, "component string, name string, content string")


def point_capture(captures: DataFrame, package: str, version: str) -> DataFrame:
    """One published capture; of several the latest."""
    found = captures.filter((F.col("package") == package) & (F.col("version") == version))
    return found.orderBy(F.col("captured_at").desc_nulls_last()).limit(1) if "captured_at" in captures.columns else found.limit(1)


def capture_files(spark: SparkSession, path: str) -> DataFrame:
    """(package, version, tools, error, raw) of capture records; ``tools`` is JSON text whose numbers keep their spelling."""
    from lodestrand.functions.rawjson import member_text

    text = json_file(spark, path)
    tools = F.arrow_udf(lambda a: pa.array([None if t is None else member_text(t, "tools") for t in a.to_pylist()], pa.string()), "string")
    pick = lambda k: F.get_json_object("content", f"$.{k}").alias(k)
    return text.select(pick("package"), pick("version"), tools("content").alias("tools"), pick("error"), pick("raw"))
