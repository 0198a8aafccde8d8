"""Microdata-shaped views of the test tables, as the same column expressions for Spark and for SQL.

Households come from orders and persons from line items; missing values are put in on purpose.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.operators.joins import dealt
from tallyframe.sources import land

REPLICATES = 80
BASE_YEAR, PRICE_YEAR, STATE = 1995, 1999, 8
MIN_AGE, MAX_AGE, VACANCY_RATE = 18, 45, 0.05
YEARS = tuple(range(1995, 2002))

_HOUSEHOLD = {
    "YEAR": "cast(year(o_orderdate) as int)",
    "SERIAL": "o_orderkey",
    "CBSERIAL": "o_orderkey*10",
    "SAMPLE": "cast(year(o_orderdate)*100+1 as int)",
    "STATEFIP": "case when o_custkey%10=0 then 4 else 8 end",
    "MET2013": "case when year(o_orderdate) in (1996,1997) then null else cast(c_nationkey as int) end",
    "PUMA": "cast(o_custkey%5 as int)",
    "GQ": "cast(o_orderkey%6 as int)",
    "VACANCY": "cast(floor(o_orderkey/6)%8 as int)",
    "VACDUR": "case when o_orderkey%11=0 then null else cast(o_orderkey%10 as int) end",
    "KITCHEN": "case when o_custkey%4=0 then 1 else 4 end",
    "PLUMBING": "case when o_custkey%7=0 then 10 else 20 end",
    "OWNERSHP": "cast(floor(o_orderkey/48)%3 as int)",
    "OWNCOST": "case when o_orderkey%13=0 then 99999 else cast(o_custkey%4000 as int) end",
    "RENTGRS": "cast(o_custkey%3000 as int)",
    "HHINCOME": "case when o_orderkey%17=0 then 9999999 else cast(floor(o_totalprice) as int) end",
    "HHWT": "cast(1+o_orderkey%97 as int)",
    **{f"REPWT{r}": f"cast(1+o_orderkey%97+(o_orderkey*31+{r}*17)%7-3 as int)"
       for r in range(1, REPLICATES + 1)},
}
_PERSON = {
    "YEAR": "cast(year(o_orderdate) as int)",
    "SERIAL": "l_orderkey",
    "CBSERIAL": "l_orderkey*10",
    "SAMPLE": "cast(year(o_orderdate)*100+1 as int)",
    "PERNUM": "l_linenumber",
    "RELATE": "l_linenumber",
    "AGE": "cast(l_partkey%96 as int)",
    "INCTOT": "case when l_suppkey%19=0 then 9999999 else cast(floor(l_extendedprice) as int)-2000 end",
    "FTOTINC": "cast(floor(l_extendedprice) as int)",
    "MARST": "cast(l_suppkey%6+1 as int)",
    "LABFORCE": "cast(floor(l_extendedprice)%3 as int)",
    "EDUC": "cast(floor(l_extendedprice/3)%12 as int)",
    "MULTGEN": "cast(floor(l_orderkey/7)%4 as int)",
    "NCHILD": "cast(floor(l_extendedprice/36)%4 as int)",
    "PERWT": "cast(l_quantity as int)",
    **{f"REPWTP{r}": f"cast(cast(l_quantity as int)+(l_partkey*31+{r}*17)%7-3 as int)"
       for r in range(1, REPLICATES + 1)},
}
_CPI = {
    "observation_date": "cast(date_trunc('month',o_orderdate) as date)",
    "CPIAUCSL": "cast(150.0+0.25*(year(o_orderdate)*12+month(o_orderdate)-1995*12) as double)",
}


def _select(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in cols.items())


def _cols(cols: dict[str, str]) -> list[str]:
    return [f"{e} as {n}" for n, e in cols.items()]


@lru_cache(maxsize=64)
def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Views that were landed as microdata files, by session and source folder.
_landed: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def land_views(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write households and persons as yearly Parquet, as microdata lies in practice, and use them from now on."""
    tables = {"household": households(spark, sf_dir), "person": persons(spark, sf_dir)}
    for name, df in tables.items():
        land(df, f"{folder}/{name}")
    _landed[spark, sf_dir] = tuple(
        spark.read.parquet(f"{folder}/{name}").select(*df.columns) for name, df in tables.items())


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    if (spark, sf_dir) in _landed:
        return _landed[spark, sf_dir][0]
    orders, customer = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).selectExpr(*_cols(_HOUSEHOLD))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    if (spark, sf_dir) in _landed:
        return _landed[spark, sf_dir][1]
    lineitem, orders = dealt(_read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders"), [F.col("l_orderkey")], [F.col("o_orderkey")])
    return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).selectExpr(*_cols(_PERSON))


def cpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(*_cols(_CPI)).distinct()


def area_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").selectExpr(
        "n_nationkey as val", "n_name as lbl")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested labels per variable, as read from a codebook."""
    flat = _read(spark, sf_dir, "nation").selectExpr(
        "'MET2013' as var_name", "n_nationkey as val", "n_name as lbl").unionByName(
        _read(spark, sf_dir, "region").selectExpr(
            "'REGION' as var_name", "r_regionkey as val", "r_name as lbl"))
    return flat.groupBy("var_name").agg(
        F.sort_array(F.collect_list(F.struct("val", "lbl"))).alias("val_labels"))


def projection_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr(
        "cast(floor(c_custkey/40)%2 as int) as area_code", "cast(1998+c_custkey%8 as int) as year",
        "cast(c_custkey%5 as int) as age_group_id",
        "cast(floor(c_custkey/80)%2 as int) as household_type_id").groupBy(
        "area_code", "year", "age_group_id", "household_type_id").count().selectExpr(
        "area_code", "year", "age_group_id", "household_type_id",
        "concat('group ', cast(age_group_id as string)) as age_group_description",
        "cast(count*1000 as bigint) as total_households")


def projection_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).selectExpr(
        "cast(0 as int) as countyfips", "cast(year(o_orderdate)+3 as int) as year",
        "cast(l_partkey%96 as int) as age", "cast(l_quantity as int) as q").groupBy(
        "countyfips", "year", "age").agg({"q": "sum"}).withColumnRenamed("sum(q)", "totalpopulation")


# The same views as common table expressions.
SQL = {
    "hh": f"select {_select(_HOUSEHOLD)} from orders join customer on o_custkey=c_custkey",
    "pp": f"select {_select(_PERSON)} from lineitem join orders on l_orderkey=o_orderkey",
    "cpi": f"select distinct {_select(_CPI)} from orders",
    "lab": "select n_nationkey as val, n_name as lbl from nation",
    "dict": "select 'MET2013' as var_name, n_nationkey as val, n_name as lbl from nation "
            "union all select 'REGION', r_regionkey, r_name from region",
    "ph": "select cast(floor(c_custkey/40)%2 as int) as area_code, cast(1998+c_custkey%8 as int) as year, "
          "cast(c_custkey%5 as int) as age_group_id, cast(floor(c_custkey/80)%2 as int) as household_type_id, "
          "concat('group ', cast(c_custkey%5 as varchar)) as age_group_description, "
          "cast(count(*)*1000 as bigint) as total_households from customer group by 1,2,3,4,5",
    "ppop": "select cast(0 as int) as countyfips, cast(year(o_orderdate)+3 as int) as year, "
            "cast(l_partkey%96 as int) as age, cast(sum(cast(l_quantity as int)) as bigint) as totalpopulation "
            "from lineitem join orders on l_orderkey=o_orderkey group by 1,2,3",
}


def weight_columns(kind: str) -> tuple[str, list[str]]:
    """Weight and replicate weight names of the household (``hh``) or person (``pp``) view."""
    if kind == "hh":
        return "HHWT", [f"REPWT{r}" for r in range(1, REPLICATES + 1)]
    return "PERWT", [f"REPWTP{r}" for r in range(1, REPLICATES + 1)]
