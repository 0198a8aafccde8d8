"""Aggregations and survey estimates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tallyframe import functions as fn
from tallyframe.operators import (
    SurveyDesign, across, append_totals, keyed_join, survey_count, survey_counts, survey_mean, weighted_median,
)
from tallyframe.plans import codes, headship, housing
from tallyframe.session import stage
from tallyframe.workload import prepared, views
from tallyframe.workload.registry import query
from tallyframe.workload.sqltext import DEFL, PEOPLE, UNITS, se, strict
from tallyframe.workload.views import STATE, YEARS, weight_columns

HW, HR = weight_columns("hh")
PW, PR = weight_columns("pp")

MARKET = """market as (select * replace (case when VACANCY=3 then 0 else VACANCY end as VACANCY) from hh
  where GQ in (0,1,2,5) and VACANCY not in (4,5,6,7,9))"""


@query("A1_weighted_count", "YEAR:int n:bigint", "hh", "select YEAR, sum(HHWT) as n from hh group by 1")
def _(spark, sf_dir):
    return views.households(spark, sf_dir).groupBy("YEAR").agg(fn.sum0(F.col("HHWT")).alias("n"))


@query("A2_survey_count_se", "YEAR:int msa:str n:bigint n_se:d6", "hh lab",
       f"with {UNITS}\nselect YEAR, msa, sum(HHWT) as n, {se(HW, HR)} as n_se from units group by 1,2")
def _(spark, sf_dir):
    """Summed by area code first; names meet the few sums."""
    design = housing.household_design(prepared.units(spark, sf_dir)).collapse("YEAR", "MET2013")
    named = replace(design, df=housing.attach_area(design.df, views.area_labels(spark, sf_dir)))
    return survey_count(named, ["YEAR", "msa"])


def _mean_se(y: str, w: str, reps: list[str]) -> str:
    def theta(c):
        return f"cast(sum({y}*{c}) as double)/sum({c})"
    return f"sqrt(4.0e0/{len(reps)}*({'+'.join(f'power({theta(r)}-{theta(w)},2)' for r in reps)}))"


_HEAD = "cast(HEADSHIP as int)"


@query("A3_survey_mean_se", "AGEGROUP:str YEAR:int HEADSHIP:d6 HEADSHIP_se:d6", "hh pp lab cpi",
       f"""with {UNITS}, {DEFL}, {PEOPLE}
       \nselect AGEGROUP, YEAR, cast(sum({_HEAD}*PERWT) as double)/sum(PERWT) as HEADSHIP,
       {_mean_se(_HEAD, PW, PR)} as HEADSHIP_se from people where STATEFIP=8 and AGE>=15 group by 1,2""")
def _(spark, sf_dir):
    here = prepared.members(spark, sf_dir).filter((F.col("STATEFIP") == STATE) & (F.col("AGE") >= 15))
    return survey_mean(housing.person_design(here), ["AGEGROUP", "YEAR"], "HEADSHIP")


@query("A3_survey_mean_se_of_a_number", "YEAR:int NCHILD:d6 NCHILD_se:d6", "pp",
       f"""select YEAR, cast(sum(NCHILD*PERWT) as double)/sum(PERWT) as NCHILD,
       {_mean_se('NCHILD', PW, PR)} as NCHILD_se from pp group by 1""")
def _(spark, sf_dir):
    return survey_mean(housing.person_design(views.persons(spark, sf_dir)), ["YEAR"], "NCHILD")


@query("M2_weights_only_design", "YEAR:int n:bigint replicate_n:bigint", "hh",
       "select YEAR, sum(HHWT) as n, sum(HHWT) as replicate_n from hh group by 1")
def _(spark, sf_dir):
    """The weights alone give the same estimate as the design with replicates."""
    hh = views.households(spark, sf_dir)
    alone = survey_count(SurveyDesign(hh, "HHWT", (), 0.0), ["YEAR"]).select("YEAR", "n")
    return keyed_join(alone, survey_count(housing.household_design(hh), ["YEAR"], "replicate_n"), ["YEAR"])


@query("A4_weighted_mean", "YEAR:int AGE:d6", "pp",
       "select YEAR, cast(sum(AGE*PERWT) as double)/sum(PERWT) as AGE from pp group by 1")
def _(spark, sf_dir):
    return views.persons(spark, sf_dir).groupBy("YEAR").agg(
        fn.weighted_mean(F.col("AGE"), F.col("PERWT")).alias("AGE"))


@query("A5_strict_sum_of_products", "YEAR:int area:bigint quarters:bigint", "hh",
       f"select YEAR, {strict('MET2013*HHWT')} as area, {strict('GQ*HHWT')} as quarters from hh group by 1")
def _(spark, sf_dir):
    """A sum is missing in the years in which one product is."""
    w = F.col("HHWT")
    return views.households(spark, sf_dir).groupBy("YEAR").agg(
        fn.strict_sum(F.col("MET2013") * w).alias("area"), fn.strict_sum(F.col("GQ") * w).alias("quarters"))


@query("A6_sum_present_over_columns", "MET2013:int VACDUR:bigint OWNCOST:bigint HHWT:bigint", "hh",
       """select MET2013, coalesce(sum(VACDUR),0) as VACDUR, coalesce(sum(OWNCOST),0) as OWNCOST,
       coalesce(sum(HHWT),0) as HHWT from hh group by 1""")
def _(spark, sf_dir):
    return views.households(spark, sf_dir).groupBy("MET2013").agg(
        *across(["VACDUR", "OWNCOST", "HHWT"], fn.sum0))


@query("A7_mean", "YEAR:int rent:d6 duration:d6", "hh",
       """select YEAR, avg(RENTGRS) as rent, case when count(VACDUR)=count(*) then avg(VACDUR) end as duration
       from hh group by 1""")
def _(spark, sf_dir):
    return views.households(spark, sf_dir).groupBy("YEAR").agg(
        fn.strict_mean(F.col("RENTGRS")).alias("rent"), fn.strict_mean(F.col("VACDUR")).alias("duration"))


def _median_sql(source: str, by: str, x: str, w: str) -> str:
    return f"""
    select {by}, (min(case when cw*2>=t then x end)+min(case when cw*2>t then x end))/2 as median from (
      select {by}, x, sum(w) over (partition by {by} order by x) as cw, sum(w) over (partition by {by}) as t
      from (select {by}, {x} as x, sum({w}) as w from {source} where {x} is not null group by {by}, {x}))
    group by {by}"""


@query("A8_weighted_median", "YEAR:int AGEGROUP:str median:d6", "hh pp lab cpi",
       f"with {UNITS}, {DEFL}, {PEOPLE}\n" + _median_sql("people", "YEAR, AGEGROUP", "HCOSTRATIO", "PERWT").strip())
def _(spark, sf_dir):
    by = ["YEAR", "AGEGROUP"]
    rows = stage(prepared.analysis_people(spark, sf_dir).select(*by, "HCOSTRATIO", "PERWT"))
    return weighted_median(rows, by, "HCOSTRATIO", "PERWT", "median")


@query("A8_weighted_median_of_codes", "MET2013:int median:d6", "hh",
       _median_sql("hh", "MET2013", "cast(VACDUR as double)", "HHWT"))
def _(spark, sf_dir):
    """Many ties and a missing group key."""
    return weighted_median(views.households(spark, sf_dir), ["MET2013"], "VACDUR", "HHWT", "median")


@query("A9_conditional_sums", "YEAR:int SEASONAL:bigint UNINHABITABLE:bigint HOUSEHOLDS:bigint HU:bigint",
       "hh", """select YEAR, sum(HHWT*cast(VACANCY=4 as int)) as SEASONAL,
       sum(HHWT*cast((KITCHEN=1 or PLUMBING=10) and VACANCY<>0 as int)) as UNINHABITABLE,
       sum(HHWT*cast(VACANCY=0 as int)) as HOUSEHOLDS, sum(HHWT) as HU from hh
       where STATEFIP=8 and GQ not in (3,4) group by 1""")
def _(spark, sf_dir):
    return housing.yearly_units(prepared.units(spark, sf_dir, "vacant"), STATE)


@query("A10_total_rows", "YEAR:int OWNERSHP:str n:bigint cost:bigint", "hh",
       """with d as (select YEAR, cast(OWNERSHP as varchar) as OWNERSHP, sum(HHWT) as n, sum(RENTGRS) as cost
       from hh group by 1,2)
       \nselect YEAR, OWNERSHP, n, cost from d union all select YEAR, 'total', sum(n), sum(cost) from d group by 1""")
def _(spark, sf_dir):
    d = views.households(spark, sf_dir).groupBy("YEAR", F.col("OWNERSHP").cast("string").alias("OWNERSHP")).agg(
        F.sum("HHWT").alias("n"), F.sum("RENTGRS").alias("cost"))
    return append_totals(d, ["YEAR"], "OWNERSHP", "total", ["n", "cost"])


@query("A11_ratio_of_totals", "YEAR:int VACANCY:str heads:bigint units:bigint rate:d6", "hh",
       """with d as (select YEAR, cast(VACANCY as varchar) as VACANCY, sum(case when OWNERSHP=1 then HHWT else 0 end)
       as heads, sum(HHWT) as units from hh group by 1,2)
       \nselect YEAR, VACANCY, heads, units, cast(heads as double)/units as rate from (select * from d union all
       select YEAR, 'total', sum(heads), sum(units) from d group by 1)""")
def _(spark, sf_dir):
    """The total row's rate is the ratio of its sums, not a sum of rates."""
    rate = fn.ratio(F.col("heads"), F.col("units"))
    d = views.households(spark, sf_dir).groupBy("YEAR", F.col("VACANCY").cast("string").alias("VACANCY")).agg(
        F.sum(F.when(F.col("OWNERSHP") == 1, F.col("HHWT")).otherwise(0)).alias("heads"),
        F.sum("HHWT").alias("units")).withColumn("rate", rate)
    return append_totals(d, ["YEAR"], "VACANCY", "total", ["heads", "units"], derived={"rate": rate})


@query("A12_grand_total", "units:bigint heads:bigint", "hh",
       "select sum(HHWT) as units, sum(case when VACANCY=0 then HHWT end) as heads from hh")
def _(spark, sf_dir):
    w = F.col("HHWT")
    return views.households(spark, sf_dir).agg(
        fn.strict_sum(w).alias("units"), F.sum(F.when(F.col("VACANCY") == 0, w)).alias("heads"))


@query("A15_distinct", "YEAR:int SAMPLE:int MET2013:int", "hh", "select distinct YEAR, SAMPLE, MET2013 from hh")
def _(spark, sf_dir):
    return views.households(spark, sf_dir).select("YEAR", "SAMPLE", "MET2013").distinct()


@query("A16_margins_of_error", "YEAR:int VACANCY:str n:bigint moe:d6", "hh",
       f"""with d as (select YEAR, cast(VACANCY as varchar) as VACANCY, sum(HHWT) as n, {se(HW, HR)}*1.645e0 as moe
       from hh group by 1,2)
       \nselect * from d union all select YEAR, 'total', sum(n), sum(moe) from d group by 1""")
def _(spark, sf_dir):
    """Margins of error, added up in the total row."""
    d = survey_count(housing.household_design(views.households(spark, sf_dir)), ["YEAR", "VACANCY"])
    d = d.select("YEAR", F.col("VACANCY").cast("string").alias("VACANCY"), "n",
                 (F.col("n_se") * codes.MOE_FACTOR).alias("moe"))
    return append_totals(d, ["YEAR"], "VACANCY", "total", ["n", "moe"])


@query("F9_domain_of_a_design", "YEAR:int n:bigint n_se:d6", "hh lab",
       f"with {UNITS}\nselect YEAR, sum(HHWT) as n, {se(HW, HR)} as n_se from units where SEASONAL group by 1")
def _(spark, sf_dir):
    design = housing.household_design(prepared.units(spark, sf_dir))
    return survey_count(design.filter(F.col("SEASONAL")), ["YEAR"])


@query("M1_several_domains_one_pass", "YEAR:int owned:bigint owned_se:d6 rented:bigint rented_se:d6 "
       "long_vacant:bigint long_vacant_se:d6", "hh",
       f"""with a as (select YEAR, sum(HHWT) as n, {se(HW, HR)} as s from hh where OWNERSHP=1 group by 1),
       b as (select YEAR, sum(HHWT) as n, {se(HW, HR)} as s from hh where OWNERSHP=2 group by 1),
       c as (select YEAR, sum(HHWT) as n, {se(HW, HR)} as s from hh where VACDUR>=7 group by 1)
       \nselect a.YEAR, a.n as owned, a.s as owned_se, b.n as rented, b.s as rented_se, c.n as long_vacant,
       c.s as long_vacant_se from a left join b on a.YEAR=b.YEAR left join c on a.YEAR=c.YEAR""")
def _(spark, sf_dir):
    return survey_counts(housing.household_design(views.households(spark, sf_dir)), ["YEAR"], {
        "owned": F.col("OWNERSHP") == 1, "rented": F.col("OWNERSHP") == 2,
        "long_vacant": F.col("VACDUR") >= 7})


def _counts_cte(name: str, cond: str, reps: list[str]) -> str:
    return (f"{name} as (select YEAR, msa, sum(HHWT) as n, {se(HW, reps)} as s from units where {cond} "
            f"group by 1,2)")


_FIVE = {"housing_units": "true", "housing_units_seasonal": "SEASONAL",
         "housing_units_uninhabitable": "UNINHABITABLE", "housing_units_vacant": "VACAVAIL",
         "households": "STATEFIP=8 and VACANCY=0"}
_FIVE_CTES = ",\n".join(_counts_cte(f"c{i}", cond, HR) for i, cond in enumerate(_FIVE.values()))
_FIVE_JOINS = " ".join(f"left join c{i} on c0.YEAR=c{i}.YEAR and c0.msa is not distinct from c{i}.msa"
                       for i in range(1, 5))


@query("D3_unit_counts_se", "YEAR:int msa:str " + " ".join(f"{n}:bigint {n}_se:d6" for n in _FIVE), "hh lab",
       f"with {UNITS},\n{_FIVE_CTES}\nselect c0.YEAR, c0.msa, "
       + ", ".join(f"c{i}.n as {n}, c{i}.s as {n}_se" for i, n in enumerate(_FIVE)) + f" from c0 {_FIVE_JOINS}")
def _(spark, sf_dir):
    """Five domain counts with standard errors from one pass over the households."""
    return housing.unit_counts(prepared.units(spark, sf_dir), views.area_labels(spark, sf_dir), STATE)


_D8 = " ".join(f"{y}:d6" for y in YEARS)


@query("D8_headship_table", f"AGEGROUP:str TYPE:str {_D8}", "hh pp lab cpi",
       f"""with {UNITS}, {DEFL}, {PEOPLE}, r as (
       select AGEGROUP, YEAR, cast(sum({_HEAD}*PERWT) as double)/sum(PERWT) as m, {_mean_se(_HEAD, PW, PR)} as s
       from people where STATEFIP=8 and AGE>=15 group by 1,2), l as (
       select AGEGROUP, YEAR, 'HEADSHIP' as TYPE, m as v from r union all
       select AGEGROUP, YEAR, 'HEADSHIP_se', s from r)
       \nselect AGEGROUP, TYPE, """ + ", ".join(f'max(case when YEAR={y} then v end) as "{y}"' for y in YEARS)
       + " from l group by 1,2")
def _(spark, sf_dir):
    return headship.headship_table(prepared.members(spark, sf_dir), STATE, YEARS)
