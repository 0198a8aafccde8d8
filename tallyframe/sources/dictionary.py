"""Data dictionaries: variables with their position in the record and their value labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.sources.microdata import Field

_VAR = """_name string, _dcml string, _rectype string, _intrvl string, labl string,
    location struct<_StartPos: int, _EndPos: int, _width: int>,
    varFormat struct<_type: string>,
    catgry array<struct<catValu: string, labl: string>>"""


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """One row per variable of an XML codebook: name, label, position, types, nested ``val_labels``.

    A label has its code as written, and as a number (``val``) where it is one.
    """
    raw = spark.read.format("xml").option("rowTag", "var").schema(_VAR).load(path)
    labels = F.transform("catgry", lambda c: F.struct(
        c["catValu"].try_cast("int").alias("val"), c["labl"].alias("lbl"), F.trim(c["catValu"]).alias("code")))
    return raw.select(
        F.col("_name").alias("var_name"), F.trim("labl").alias("var_label"),
        F.col("location._StartPos").alias("start"), F.col("location._width").alias("width"),
        F.coalesce(F.col("_dcml").cast("int"), F.lit(0)).alias("decimals"),
        F.col("_rectype").alias("rectypes"), F.col("varFormat._type").alias("format"),
        F.coalesce(labels, F.array().cast("array<struct<val:int,lbl:string,code:string>>")).alias("val_labels"))


def value_labels(dictionary: DataFrame, variable: str) -> DataFrame:
    """``val, lbl`` of one variable with numeric codes."""
    return _labels(dictionary, variable, "val").filter(F.col("val").isNotNull())


def text_labels(dictionary: DataFrame, variable: str) -> DataFrame:
    """``code, lbl`` of one variable, codes as written."""
    return _labels(dictionary, variable, "code")


def _labels(dictionary: DataFrame, variable: str, key: str) -> DataFrame:
    nested = F.transform("val_labels", lambda v: F.struct(v[key].alias(key), v["lbl"].alias("lbl")))
    return dictionary.filter(F.col("var_name") == variable).select(F.inline(nested))


def dictionary_layout(dictionary: DataFrame) -> list[Field]:
    """Record layout; a codebook describes some hundred variables, so it is fetched."""
    rows = dictionary.select("var_name", "start", "width", "decimals", "rectypes", "format").collect()
    return [Field(r.var_name, r.start, r.width, r.decimals, tuple((r.rectypes or "").split()),
                  r.format == "character") for r in rows]
