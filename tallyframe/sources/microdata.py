"""Fixed-width microdata, hierarchical or rectangular, and its landed columnar form."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Field:
    """A variable's place in the record; ``rectypes`` is empty when every record has it."""

    name: str
    start: int
    width: int
    decimals: int = 0
    rectypes: tuple[str, ...] = ()
    text: bool = False

    def raw(self, line: Column) -> Column:
        text = F.trim(F.substring(line, self.start, self.width))
        return F.when(text != "", text)

    def column(self, line: Column) -> Column:
        """The typed value; blank, or no number where one is due, is missing (see :func:`malformed_fields`)."""
        present = self.raw(line)
        if self.text:
            return present.alias(self.name)
        if self.decimals:
            return (present.try_cast("long") / F.lit(10.0 ** self.decimals)).alias(self.name)
        return present.try_cast("long" if self.width > 9 else "int").alias(self.name)


def parse_records(lines: DataFrame, layout: Sequence[Field], line: str = "value") -> DataFrame:
    """Typed columns from fixed-width lines; blanks are missing."""
    return lines.select(*[f.column(F.col(line)) for f in layout])


def malformed_fields(lines: DataFrame, layout: Sequence[Field], line: str = "value") -> DataFrame:
    """``field, n``: how many records hold something else than a number in a numeric field. Of a hierarchical
    extract pass the lines of one record type with its fields."""
    numeric = [f for f in layout if not f.text]
    bad = [F.count(F.when(f.raw(F.col(line)).isNotNull() & f.column(F.col(line)).isNull(), 1)).alias(f.name) for f in numeric]
    counted = lines.agg(*bad)
    return counted.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f.name).alias("n")) for f in numeric])))


def split_records(lines: DataFrame, layout: Sequence[Field], line: str = "value",
                  marker: str = "RECTYPE", kinds: tuple[str, str] = ("H", "P")) -> tuple[DataFrame, DataFrame]:
    """Household and person tables from interleaved records told apart by ``marker``."""
    tag = next(f for f in layout if f.name == marker)
    out = []
    for kind in kinds:
        own = [f for f in layout if not f.rectypes or kind in f.rectypes]
        mine = lines.filter(F.substring(F.col(line), tag.start, tag.width) == kind)
        out.append(parse_records(mine, own, line))
    return out[0], out[1]


def read_hierarchical(spark: SparkSession, path: str, layout: Sequence[Field]) -> tuple[DataFrame, DataFrame]:
    """Household and person tables of a hierarchical extract. Land them before repeated use."""
    return split_records(spark.read.text(path), layout)


def read_rectangular(spark: SparkSession, path: str, layout: Sequence[Field]) -> DataFrame:
    """One table with household columns repeated on person rows."""
    return parse_records(spark.read.text(path), layout)


def land(df: DataFrame, path: str, by: str | Sequence[str] = "YEAR") -> None:
    """Write Parquet in one folder per year (or more columns), so that year filters skip files and later reads only touch
    the columns asked for. Rebalancing brings a year's rows together into files of even size and splits
    a year that holds most of the rows over many tasks."""
    by = [by] if isinstance(by, str) else list(by)
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def land_bucketed(df: DataFrame, table: str, path: str, buckets: int,
                  keys: Sequence[str] = ("YEAR", "SERIAL", "SAMPLE")) -> None:
    """Write a catalog table bucketed by household, so that households and persons landed with the same
    ``buckets`` join without moving their replicate weights.

    Needs ``spark.sql.requireAllClusterKeysForCoPartition=false`` when joining, as the join also compares
    the nullable key. A household is a handful of rows, so buckets come out even; data whose keys are
    not like that belongs in :func:`land`, where the join shuffles and skewed partitions are split.
    """
    (df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(table))


def landed_or(spark: SparkSession, path: str, build: Callable[[], DataFrame],
              by: str | Sequence[str] = "YEAR") -> DataFrame:
    """The landed copy if a whole one is there, which the marker of a finished write tells; else ``build`` it, land
    it and read it back. What an interrupted landing has left is written over."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        land(build(), path, by)
    return spark.read.parquet(path)


def land_extract(spark: SparkSession, data: str, layout: Sequence[Field], folder: str) -> tuple[DataFrame, DataFrame]:
    """Household and person tables of a hierarchical extract, landed under ``folder`` on first use.

    The text is parsed once, into one landing by record type and year in which a record leaves the other types'
    fields empty; each table is read back from its part. Uncompressed text is split over tasks; a gzip file is
    one task, so unpack large ones first.
    """
    marker, kinds = "RECTYPE", ("H", "P")
    tag = next(f for f in layout if f.name == marker)

    def build() -> DataFrame:
        lines = spark.read.text(data)
        kind = F.substring("value", tag.start, tag.width)
        wide: dict[str, Column] = {}
        for f in layout:
            if f.name != marker:
                here = f.column(F.col("value"))
                own = F.when(kind.isin(*f.rectypes), here) if f.rectypes else here
                wide[f.name] = F.coalesce(wide[f.name], own) if f.name in wide else own
        return lines.filter(kind.isin(*kinds)).select(kind.alias(marker), *[c.alias(n) for n, c in wide.items()])

    whole = landed_or(spark, f"{folder}/records", build, (marker, "YEAR"))
    tables = [whole.filter(F.col(marker) == k).select(*dict.fromkeys(
        f.name for f in layout if not f.rectypes or k in f.rectypes)) for k in kinds]
    return tables[0], tables[1]
