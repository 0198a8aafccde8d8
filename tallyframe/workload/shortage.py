"""Housing-need estimates: units, headship, missing households, vacancy, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import functions as fn
from tallyframe.operators import keyed_join
from tallyframe.plans import (
    counterfactual, headship, housing, people, prices, projections, shortfall, target_rates, vacancy,
)
from tallyframe.plans.labels import label_table
from tallyframe.sources import value_labels
from tallyframe.workload import prepared, views
from tallyframe.workload.registry import query
from tallyframe.workload.sqltext import AGEGROUP, DEFL, PEOPLE, UNITS, se, strict
from tallyframe.workload.survey import MARKET
from tallyframe.workload.views import BASE_YEAR, MAX_AGE, MIN_AGE, PRICE_YEAR, STATE, VACANCY_RATE, YEARS, weight_columns

HW, HR = weight_columns("hh")
PW, PR = weight_columns("pp")
_HEAD = "cast(HEADSHIP as int)"
_PREP = f"{UNITS}, {DEFL}, {PEOPLE}"


# --- units -----------------------------------------------------------------------------------------

@query("D1_unit_flags", "YEAR:int seasonal:bigint available:bigint vacant:bigint", "hh lab",
       f"""with {UNITS}\nselect YEAR, sum(cast(SEASONAL as int)) as seasonal, sum(cast(VACAVAIL as int)) as available,
       sum(cast(VACANT as int)) as vacant from units group by 1""")
def _(spark, sf_dir):
    return prepared.units(spark, sf_dir).groupBy("YEAR").agg(
        *[F.sum(fn.flag(F.col(c))).alias(n) for c, n in
          (("SEASONAL", "seasonal"), ("VACAVAIL", "available"), ("VACANT", "vacant"))])


_LACK = "(KITCHEN=1 or PLUMBING=10)"
for _mode, _sql in (
        ("duration_or_listed", f"{_LACK} and case when VACDUR is null then VACANCY in (1,2,3) else VACDUR>=7 end"),
        ("duration", f"{_LACK} and VACDUR>=7"),
        ("vacant", f"{_LACK} and VACANCY<>0")):
    @query(f"D2_uninhabitable_{_mode}", "SERIAL:bigint UNINHABITABLE:bool", "hh",
           f"select SERIAL, {_sql} as UNINHABITABLE from hh where GQ not in (3,4)")
    def _(spark, sf_dir, mode=_mode):
        return prepared.units(spark, sf_dir, mode)


@query("D3_unit_counts", "YEAR:int msa:str housing_units:bigint housing_units_seasonal:bigint "
       "housing_units_uninhabitable:bigint housing_units_vacant:bigint households:bigint", "hh lab",
       f"""with {UNITS}\nselect YEAR, msa, sum(HHWT) as housing_units,
       sum(case when SEASONAL then HHWT end) as housing_units_seasonal,
       sum(case when UNINHABITABLE then HHWT end) as housing_units_uninhabitable,
       sum(case when VACAVAIL then HHWT end) as housing_units_vacant,
       sum(case when STATEFIP=8 and VACANCY=0 then HHWT end) as households from units group by 1,2""")
def _(spark, sf_dir):
    return housing.unit_counts(prepared.units(spark, sf_dir), views.area_labels(spark, sf_dir), STATE, se=False)


@query("D4_deflator", "YEAR:int cpi:d6 adj_factor:d6", "cpi", f"with {DEFL}\nselect YEAR, cpi, adj_factor from defl")
def _(spark, sf_dir):
    return prices.deflator(views.cpi(spark, sf_dir), PRICE_YEAR)


# --- persons ---------------------------------------------------------------------------------------

@query("D5_income_and_cost_recodes", "SERIAL:bigint PERNUM:int HHINCOME:int OWNCOST:int INCTOT:int HOUSINGCOST:int",
       "hh pp lab cpi", f"""with {_PREP}\nselect SERIAL, PERNUM, HHINC0 as HHINCOME, OWNCOST0 as OWNCOST,
       INCTOT1 as INCTOT, COST0 as HOUSINGCOST from people1""")
def _(spark, sf_dir):
    return people.with_costs(prepared.members(spark, sf_dir))


@query("D6_real_money", "SERIAL:bigint PERNUM:int INCTOT:d4 HHINCOME:d4 FTOTINC:d4 HOUSINGCOST:d6 HCOSTRATIO:d6",
       "hh pp lab cpi",
       f"with {_PREP}\nselect SERIAL, PERNUM, INCTOT, HHINCOME, FTOTINC, HOUSINGCOST, HCOSTRATIO from people")
def _(spark, sf_dir):
    return prepared.analysis_people(spark, sf_dir)


@query("D7_headship_and_target_age", "SERIAL:bigint PERNUM:int HEADSHIP:bool first:bool AGEGROUP:str age_dummy:bool",
       "pp", f"""select SERIAL, PERNUM, RELATE=1 as HEADSHIP, PERNUM=1 as first, {AGEGROUP} as AGEGROUP,
       AGE>=18 and AGE<45 as age_dummy from pp""")
def _(spark, sf_dir):
    return people.with_headship(views.persons(spark, sf_dir), MIN_AGE, MAX_AGE).withColumn(
        "first", F.col("PERNUM") == 1)


# --- missing households ----------------------------------------------------------------------------

_BASE = f"""base as (select msa, AGEGROUP, MET2013, age_dummy,
    cast(sum({_HEAD}*PERWT) as double)/sum(PERWT) as NEWHR
  from people where STATEFIP=8 and YEAR=1995 group by 1,2,3,4)"""
_JOINED = """people p left join base b on p.msa is not distinct from b.msa
  and p.AGEGROUP=b.AGEGROUP and p.MET2013 is not distinct from b.MET2013 and p.age_dummy=b.age_dummy"""
_CELLS = f"""{_BASE},
cells0 as (select p.YEAR, p.msa, p.AGEGROUP, p.MET2013, p.PUMA, p.age_dummy, NEWHR,
    {strict('NEWHR*PERWT')} as NEWHH_, sum({_HEAD}*PERWT) as HH
  from {_JOINED} where p.STATEFIP=8 group by 1,2,3,4,5,6,7),
cells1 as (select *, case when age_dummy and NEWHH_>HH then NEWHH_ when not (age_dummy and NEWHH_>HH) then HH end
  as NEWHH from cells0),
cells as (select *, NEWHH-HH as MISSINGHH from cells1)"""
_CELL_COLS = "YEAR:int msa:str AGEGROUP:str MET2013:int PUMA:int age_dummy:bool NEWHR:d6 NEWHH_:d7 HH:bigint " \
             "NEWHH:d7 MISSINGHH:d7"


def cells(spark, sf_dir):
    return headship.metro_cells(prepared.members(spark, sf_dir), views.area_labels(spark, sf_dir), STATE, BASE_YEAR)


@query("D9_missing_households_by_cell", _CELL_COLS, "hh pp lab cpi",
       f"with {_PREP}, {_CELLS}\nselect * from cells")
def _(spark, sf_dir):
    return cells(spark, sf_dir)


@query("J5_baseline_rates_joined_back", "SERIAL:bigint PERNUM:int YEAR:int NEWHR:d6", "hh pp lab cpi",
       f"with {_PREP}, {_BASE}\nselect SERIAL, PERNUM, p.YEAR as YEAR, NEWHR from {_JOINED} where p.STATEFIP=8")
def _(spark, sf_dir):
    """The join the cell form avoids: rates on every person, missing keys matching missing ones."""
    here = housing.attach_area(prepared.members(spark, sf_dir), views.area_labels(spark, sf_dir)).filter(
        F.col("STATEFIP") == STATE)
    rates = here.filter(F.col("YEAR") == BASE_YEAR).groupBy(*headship.METRO_CELL).agg(
        fn.weighted_mean(fn.flag(F.col("HEADSHIP")), F.col("PERWT")).alias("NEWHR"))
    # one row per area, age group and target-age flag: looked up, so the persons are not shuffled by them
    return keyed_join(rates, here, headship.METRO_CELL, "right")


_D9B = f"""base as (select AGEGROUP, cast(sum({_HEAD}*PERWT) as double)/sum(PERWT) as NEWHR from people
  where STATEFIP=8 and AGE>=15 and YEAR=1995 group by 1),
cells as (select p.YEAR, p.AGEGROUP, {strict('NEWHR*PERWT')} as NEWHH, sum({_HEAD}*PERWT) as HH,
    {strict('NEWHR*PERWT')} - sum({_HEAD}*PERWT) as MISSINGHH
  from people p left join base b on p.AGEGROUP=b.AGEGROUP where STATEFIP=8 and AGE>=15 group by 1,2)"""


def state_cells(spark, sf_dir):
    return headship.state_cells(prepared.members(spark, sf_dir), STATE, BASE_YEAR)


@query("D9b_missing_households_statewide", "YEAR:int AGEGROUP:str HH:bigint NEWHH:d5 MISSINGHH:d5", "hh pp lab cpi",
       f"with {_PREP}, {_D9B}\nselect YEAR, AGEGROUP, HH, NEWHH, MISSINGHH from cells")
def _(spark, sf_dir):
    return state_cells(spark, sf_dir)


_D9C = f"""base as (select AGEGROUP, PUMA, cast(sum({_HEAD}*PERWT) as double)/sum(PERWT) as NEWHR from people
  where STATEFIP=8 and AGE>=18 and AGE<45 and YEAR=1995 group by 1,2),
cells as (select p.YEAR, p.AGEGROUP, p.PUMA, {strict('NEWHR*PERWT')} as NEWHH, sum({_HEAD}*PERWT) as HH
  from people p left join base b on p.AGEGROUP=b.AGEGROUP and p.PUMA is not distinct from b.PUMA
  where STATEFIP=8 and AGE>=18 and AGE<45 group by 1,2,3)"""


def small_cells(spark, sf_dir):
    return headship.small_area_cells(prepared.members(spark, sf_dir), STATE, BASE_YEAR, MIN_AGE, MAX_AGE)


@query("D9c_missing_households_by_small_area", "YEAR:int AGEGROUP:str PUMA:int HH:bigint NEWHH:d5 MISSINGHH:d5",
       "hh pp lab cpi",
       f"with {_PREP}, {_D9C}\nselect YEAR, AGEGROUP, PUMA, HH, NEWHH, NEWHH-HH as MISSINGHH from cells")
def _(spark, sf_dir):
    return small_cells(spark, sf_dir)


@query("A13_positive_part_sum", "YEAR:int MISSINGHH:d5", "hh pp lab cpi",
       f"with {_PREP}, {_D9C}\nselect YEAR, coalesce(sum(case when NEWHH-HH>0 then NEWHH-HH end),0) as MISSINGHH "
       "from cells group by 1")
def _(spark, sf_dir):
    return headship.positive_missing(small_cells(spark, sf_dir))


_UNIT_SUMS = """uc as (select YEAR, msa, sum(HHWT) as housing_units,
    sum(case when SEASONAL then HHWT end) as housing_units_seasonal,
    sum(case when UNINHABITABLE then HHWT end) as housing_units_uninhabitable,
    sum(case when VACAVAIL then HHWT end) as housing_units_vacant from units group by 1,2)"""
_METRO = f"""{_UNIT_SUMS},
metro0 as (select YEAR, msa, sum(HH) as HH, {strict('NEWHH')} as NEWHH, {strict('MISSINGHH')} as MISSINGHH
  from cells group by 1,2),
metro as (select m.YEAR, m.msa, HH, NEWHH, MISSINGHH, housing_units_seasonal, housing_units_uninhabitable,
    housing_units_vacant, housing_units, cast(housing_units_vacant as double)/housing_units as vacancy_rate,
    (HH+MISSINGHH)/0.95e0 as necessary_units,
    housing_units-housing_units_seasonal-coalesce(housing_units_uninhabitable,0) as available_units,
    (HH+MISSINGHH)/0.95e0-(housing_units-housing_units_seasonal-coalesce(housing_units_uninhabitable,0))
      as underproduction
  from metro0 m left join uc on m.YEAR=uc.YEAR and m.msa is not distinct from uc.msa)"""
_TOTAL_COLS = ("YEAR:int msa:str HH:bigint NEWHH:d4 MISSINGHH:d4 housing_units_seasonal:bigint "
               "housing_units_uninhabitable:bigint housing_units_vacant:bigint housing_units:bigint "
               "vacancy_rate:d6 necessary_units:d4 available_units:bigint underproduction:d4")


def tables(spark, sf_dir):
    """Households, persons and area labels."""
    return views.households(spark, sf_dir), views.persons(spark, sf_dir), views.area_labels(spark, sf_dir)


@query("D10_metro_totals", _TOTAL_COLS, "hh pp lab cpi", f"with {_PREP}, {_CELLS}, {_METRO}\nselect * from metro")
def _(spark, sf_dir):
    """Shortfall by year and area, from records to totals."""
    return shortfall.area_shortfall(*tables(spark, sf_dir), STATE, BASE_YEAR, MIN_AGE, MAX_AGE, VACANCY_RATE)


_SKIP = ("HH NEWHH MISSINGHH housing_units_seasonal housing_units_uninhabitable housing_units_vacant "
         "housing_units vacancy_rate necessary_units available_units underproduction").split()


@query("D12_all_totals_published_form", _TOTAL_COLS, "hh pp lab cpi",
       f"""with {_PREP}, {_CELLS}, {_METRO}\nselect * from metro union all select YEAR, 'Statewide', """
       + ", ".join(f"coalesce(sum({c}),0)" for c in _SKIP) + " from metro group by 1")
def _(spark, sf_dir):
    return shortfall.shortfall_report(*tables(spark, sf_dir), STATE, BASE_YEAR, mode="reference")


@query("D12_all_totals_recomputed", _TOTAL_COLS, "hh pp lab cpi",
       f"""with {_PREP}, {_CELLS}, {_METRO},
       st0 as (select YEAR, 'Statewide' as msa, sum(HH) as HH, {strict('NEWHH')} as NEWHH,
         {strict('MISSINGHH')} as MISSINGHH, sum(housing_units_seasonal) as s, sum(housing_units_uninhabitable) as u,
         sum(housing_units_vacant) as v, sum(housing_units) as n from metro group by 1),
       st as (select YEAR, msa, HH, NEWHH, MISSINGHH, s, u, v, n, cast(v as double)/n, (HH+MISSINGHH)/0.95e0,
         n-s-coalesce(u,0), (HH+MISSINGHH)/0.95e0-(n-s-coalesce(u,0)) from st0)
       \nselect * from metro union all select * from st""")
def _(spark, sf_dir):
    return shortfall.shortfall_report(*tables(spark, sf_dir), STATE, BASE_YEAR)


# Persons of one age group weigh nothing in the baseline year, so their cells have no rate: a missing value.
_PERSONS0 = """pp0 as (select * replace (case when YEAR=1995 and AGE>=30 and AGE<35 then 0 else PERWT end as PERWT) from pp)"""
_PREP0 = f"{_PERSONS0}, " + _PREP.replace("pp.", "pp0.").replace("right join pp ", "right join pp0 ")
_BASE0 = _BASE.replace("/sum(PERWT)", "/nullif(sum(PERWT),0)")
_CELLS0 = _CELLS.replace(_BASE, _BASE0)
_D9C0 = _D9C.replace("/sum(PERWT)", "/nullif(sum(PERWT),0)")


def weightless(spark, sf_dir):
    persons = views.persons(spark, sf_dir)
    none = (F.col("YEAR") == BASE_YEAR) & F.col("AGE").between(30, 34)
    return persons.withColumn("PERWT", F.when(none, 0).otherwise(F.col("PERWT")))


def weightless_members(spark, sf_dir):
    return people.with_headship(people.household_members(prepared.units(spark, sf_dir), weightless(spark, sf_dir)), MIN_AGE, MAX_AGE)


@query("D9_missing_households_without_baseline_weight", _CELL_COLS, "hh pp lab cpi",
       f"with {_PREP0}, {_CELLS0}\nselect * from cells")
def _(spark, sf_dir):
    return headship.metro_cells(weightless_members(spark, sf_dir), views.area_labels(spark, sf_dir), STATE, BASE_YEAR)


@query("A13_positive_part_sum_without_baseline_weight", "YEAR:int MISSINGHH:d5", "hh pp lab cpi",
       f"with {_PREP0}, {_D9C0}\nselect YEAR, coalesce(sum(case when NEWHH-HH>0 then NEWHH-HH end),0) as MISSINGHH "
       "from cells group by 1")
def _(spark, sf_dir):
    return headship.positive_missing(headship.small_area_cells(
        weightless_members(spark, sf_dir), STATE, BASE_YEAR, MIN_AGE, MAX_AGE))


@query("D12_all_totals_without_baseline_weight", _TOTAL_COLS, "hh pp lab cpi",
       f"""with {_PREP0}, {_CELLS0}, {_METRO}\nselect * from metro union all select YEAR, 'Statewide', """
       + ", ".join(f"coalesce(sum({c}),0)" for c in _SKIP) + " from metro group by 1")
def _(spark, sf_dir):
    return shortfall.shortfall_report(views.households(spark, sf_dir), weightless(spark, sf_dir),
                                      views.area_labels(spark, sf_dir), STATE, BASE_YEAR, mode="reference")


@query("A14_regrouped_in_steps", "YEAR:int HH:bigint MISSINGHH:d4", "hh pp lab cpi",
       f"""with {_PREP}, {_CELLS}, m as (select YEAR, msa, sum(HH) as HH, {strict('MISSINGHH')} as x from cells group by 1,2)
       \nselect YEAR, sum(HH) as HH, sum(x) as MISSINGHH from m group by 1""")
def _(spark, sf_dir):
    """Cells to areas to state."""
    areas = cells(spark, sf_dir).groupBy("YEAR", "msa").agg(
        fn.strict_sum(F.col("HH")).alias("HH"), fn.strict_sum(F.col("MISSINGHH")).alias("x"))
    return areas.groupBy("YEAR").agg(F.sum("HH").alias("HH"), F.sum("x").alias("MISSINGHH"))


_D11_STATS = f"""m as (select YEAR, {strict('MISSINGHH')} as MISSINGHH from cells group by 1),
st as (select YEAR, sum(case when SEASONAL then HHWT end) as S, sum(case when UNINHABITABLE then HHWT end) as U,
  sum(case when STATEFIP=8 and VACANCY=0 then HHWT end) as H, sum(HHWT) as N from units group by 1)"""


@query("D11_underproduction_forms", "YEAR:int target_vacancy:d4 uplift:d4 stock:d4", "hh pp lab cpi",
       f"""with {_PREP}, {_D9B}, {_D11_STATS}
       \nselect m.YEAR, (H+MISSINGHH)/0.95e0-(N-S-U) as target_vacancy, (H+MISSINGHH)*1.05e0-(N-U-S) as uplift,
       (MISSINGHH+N)/0.95e0-N-S as stock from m join st on m.YEAR=st.YEAR""")
def _(spark, sf_dir):
    missing = state_cells(spark, sf_dir).groupBy("YEAR").agg(fn.strict_sum(F.col("MISSINGHH")).alias("MISSINGHH"))
    stats = counterfactual.unit_scalars(prepared.units(spark, sf_dir), STATE)
    joined = keyed_join(missing, stats, ["YEAR"])
    args = [F.col(c) for c in ("HOUSEHOLDS", "MISSINGHH", "HU", "SEASONAL", "UNINHABITABLE")]
    return joined.select("YEAR", *[housing.underproduction(*args, VACANCY_RATE, mode=m).alias(m)
                                   for m in ("target_vacancy", "uplift", "stock")])


@query("D32_yearly_statistics", "YEAR:int MISSINGHH:d0 SEASONAL:bigint UNINHABITABLE:bigint HOUSEHOLDS:bigint "
       "HU:bigint UNDERPROD:d4 DELTA:bigint", "hh pp lab cpi",
       f"""with {_PREP}, base as (select AGEGROUP85, cast(sum({_HEAD}*PERWT) as double)/sum(PERWT) as NEWHR from
         (select *, least(AGE//5, 17) as AGEGROUP85 from people) where STATEFIP=8 and AGE>=15 and YEAR=1995 group by 1),
       m as (select YEAR, round_even({strict('NEWHR*PERWT')}-sum({_HEAD}*PERWT), 0) as MISSINGHH from
         (select *, least(AGE//5, 17) as AGEGROUP85 from people where STATEFIP=8 and AGE>=15) p
         left join base b on p.AGEGROUP85=b.AGEGROUP85 group by 1),
       st as (select YEAR, sum(HHWT*cast(VACANCY=4 as int)) as SEASONAL,
         sum(HHWT*cast((KITCHEN=1 or PLUMBING=10) and VACANCY<>0 as int)) as UNINHABITABLE,
         sum(HHWT*cast(VACANCY=0 as int)) as HOUSEHOLDS, sum(HHWT) as HU from units where STATEFIP=8 group by 1)
       \nselect m.YEAR, MISSINGHH, SEASONAL, UNINHABITABLE, HOUSEHOLDS, HU,
       (HOUSEHOLDS+MISSINGHH)*1.05e0-(HU-UNINHABITABLE-SEASONAL) as UNDERPROD, HU-lag(HU) over (order by m.YEAR) as DELTA
       from m left join st on m.YEAR=st.YEAR""")
def _(spark, sf_dir):
    """Yearly statistics with age groups to 85, the widest definition of uninhabitable, and unit change."""
    rows = prepared.members(spark, sf_dir).withColumn(
        "AGEGROUP", people.age_group(F.col("AGE"), fn.age_breaks(85)))
    return housing.yearly_shortfall(headship.state_cells(rows, STATE, BASE_YEAR),
                                    housing.yearly_units(prepared.units(spark, sf_dir, "vacant"), STATE))


# --- shares ----------------------------------------------------------------------------------------

def _share_sql(kind: str, where: str) -> str:
    return f"""k as (select *, {kind} as HOUSINGTYPE from (select * replace ({_LACK} and VACDUR>=7 as UNINHABITABLE)
      from units) {where}),
    us as (select HOUSINGTYPE, sum(HHWT) as n from k group by 1),
    co as (select HOUSINGTYPE, sum(HHWT) as n from k where STATEFIP=8 group by 1)
    \nselect us.HOUSINGTYPE, printf('%.2f%%', cast(us.n as double)/(select sum(n) from us)*100) as US,
    printf('%.2f%%', cast(co.n as double)/(select sum(n) from co)*100) as STATE
    from us left join co on us.HOUSINGTYPE=co.HOUSINGTYPE"""


@query("D20_housing_type_shares", "HOUSINGTYPE:str US:str STATE:str", "hh lab", f"with {UNITS}, " + _share_sql(
    "case when SEASONAL then 'Seasonal' when UNINHABITABLE then 'Uninhabitable' else 'Remaining' end", ""))
def _(spark, sf_dir):
    return housing.share_table(prepared.units(spark, sf_dir, "duration"), housing.housing_type(), STATE)


@query("D20_occupancy_shares", "HOUSINGTYPE:str US:str STATE:str", "hh lab", f"with {UNITS}, " + _share_sql(
    "case when VACANT then 'Vacant' else 'Occupied' end", "where not (SEASONAL or UNINHABITABLE)"))
def _(spark, sf_dir):
    return housing.share_table(housing.in_use(prepared.units(spark, sf_dir, "duration")),
                               housing.occupancy_type(), STATE)


@query("D21_cost_burden_by_year", "HCOSTQ:str 1995:d6 1999:d6", "hh pp lab cpi",
       f"""with {_PREP}, h as (select YEAR, case when HCOSTRATIO<=0 then null when HCOSTRATIO<=0.35 then '0-35%'
         when HCOSTRATIO<=0.6 then '35-60%' when HCOSTRATIO is not null then '>60%' end as HCOSTQ, sum(HHWT) as P
         from people where (YEAR=1995 or YEAR=1999) and RELATE=1 and STATEFIP=8 group by 1,2),
       s as (select YEAR, HCOSTQ, cast(P as double)/sum(P) over (partition by YEAR)*100 as P from h)
       \nselect HCOSTQ, max(case when YEAR=1995 then P end) as "1995", max(case when YEAR=1999 then P end) as "1999"
       from s group by 1""")
def _(spark, sf_dir):
    return counterfactual.burden_shares(prepared.analysis_people(spark, sf_dir), STATE, (BASE_YEAR, PRICE_YEAR))


@query("D30_relabelled_baseline_year", "YEAR:int people:bigint HH:bigint", "hh pp lab cpi",
       f"""with {_PREP}, x as (select YEAR, PERWT, {_HEAD} as h from people union all
       select 9999, PERWT, {_HEAD} from people where YEAR=1995)
       \nselect YEAR, sum(PERWT) as people, sum(PERWT*h) as HH from x group by 1""")
def _(spark, sf_dir):
    rows = headship.relabelled_baseline(prepared.members(spark, sf_dir), BASE_YEAR, 9999)
    w = F.col("PERWT")
    return rows.groupBy("YEAR").agg(fn.strict_sum(w).alias("people"),
                                    fn.strict_sum(w * fn.flag(F.col("HEADSHIP"))).alias("HH"))


@query("D31_label_table", "MET2013_val:int MET2013_lbl:str REGION_val:int REGION_lbl:str", "dict",
       """with n as (select *, row_number() over (partition by var_name order by val) as r from dict)
       \nselect max(case when var_name='MET2013' then val end) as MET2013_val,
       max(case when var_name='MET2013' then lbl end) as MET2013_lbl,
       max(case when var_name='REGION' then val end) as REGION_val,
       max(case when var_name='REGION' then lbl end) as REGION_lbl from n group by r""")
def _(spark, sf_dir):
    return label_table(views.dictionary(spark, sf_dir), ["REGION", "MET2013"], last="REGION")


# --- long-run vacancy ------------------------------------------------------------------------------

_TENURE = f"""{MARKET},
v as (select YEAR, case VACANCY when 1 then 'rent' else 'own' end as tenure, sum(HHWT) as vac,
  {se(HW, HR)}*1.645e0 as vac_moe from market where VACANCY in (1,2) group by YEAR, VACANCY),
o as (select YEAR, case OWNERSHP when 1 then 'own' else 'rent' end as tenure, sum(HHWT) as occ,
  {se(HW, HR)}*1.645e0 as occ_moe from market where OWNERSHP in (1,2) group by YEAR, OWNERSHP),
t as (select v.YEAR, v.tenure, vac, vac_moe, occ, occ_moe from v left join o on v.YEAR=o.YEAR and v.tenure=o.tenure)"""
_TENURE_COLS = "YEAR:int tenure:str vac:bigint vac_moe:d5 occ:bigint occ_moe:d5"
_LONG_RUN = f"""{_TENURE},
all3 as (select * from t union all select YEAR, 'total', sum(vac), sum(vac_moe), {strict('occ')}, {strict('occ_moe')}
  from t group by 1),
rated as (select *, vac+occ as total, cast(vac as double)/(vac+occ) as vac_rate from all3),
avgd as (select *, case when count(vac_rate) over (partition by tenure)=count(*) over (partition by tenure)
  then avg(vac_rate) over (partition by tenure) end as avg_vac_rate from rated),
res as (select *, avg_vac_rate-vac_rate as diff_from_avg, (avg_vac_rate-vac_rate)*total as shortfall from avgd)"""
_RATE_COLS = "total:bigint vac_rate:d6 avg_vac_rate:d6 diff_from_avg:d6 shortfall:d4"


def tenure(spark, sf_dir):
    return vacancy.tenure_counts(vacancy.market_units(views.households(spark, sf_dir)))


@query("D13_tenure_counts", _TENURE_COLS, "hh", f"with {_TENURE}\nselect * from t")
def _(spark, sf_dir):
    return tenure(spark, sf_dir)


@query("D14_long_run_vacancy_shortfall", f"{_TENURE_COLS} {_RATE_COLS}", "hh", f"with {_LONG_RUN}\nselect * from res")
def _(spark, sf_dir):
    return vacancy.vacancy_shortfall(tenure(spark, sf_dir))


@query("D14_shortfall_of_one_year", "tenure:str vac:bigint occ:bigint shortfall:d4", "hh",
       f"""with {_LONG_RUN}\nselect concat(upper(substr(tenure,1,1)), substr(tenure,2)) as tenure, vac, occ, shortfall
       from res where YEAR=1999""")
def _(spark, sf_dir):
    return vacancy.shortfall_of_year(vacancy.vacancy_shortfall(tenure(spark, sf_dir)), 1999)


# --- target headship -------------------------------------------------------------------------------

_BANDED = f"""{MARKET},
banded as (select pp.*, case when AGE>=65 then '[65,Inf)' when AGE<15 then null
    else '[' || cast(AGE//5*5 as varchar) || ',' || cast(AGE//5*5+5 as varchar) || ')' end as age_bin,
    case when AGE<18 then null when AGE<=24 then 1 when AGE<=44 then 2 when AGE<=64 then 3 else 4 end as age_group_id
  from pp left join market m on pp.YEAR=m.YEAR and pp.SERIAL=m.SERIAL where m.GQ in (1,2,5))"""
_TARGETS = f"""{_BANDED},
heads as (select YEAR, age_bin, sum(PERWT) as total_hh, {se(PW, PR)} as total_hh_se from banded where PERNUM=1 group by 1,2),
pers as (select YEAR, age_bin, sum(PERWT) as total_persons, {se(PW, PR)} as total_persons_se from banded group by 1,2),
r0 as (select h.YEAR, h.age_bin, total_hh, total_hh_se, total_persons, total_persons_se,
  cast(total_hh as double)/total_persons as hr from heads h left join pers p on h.YEAR=p.YEAR
  and h.age_bin is not distinct from p.age_bin),
r1 as (select e as end_year, r0.*, avg(hr) filter (where YEAR<=e) over (partition by e, age_bin) as target_hr
  from r0, (select unnest([1996, 1998, 2000]) as e)),
r2 as (select *, target_hr*total_persons as target_hh, target_hr*total_persons-total_hh as missing_hh from r1),
targets as (select end_year, YEAR, age_bin, total_hh, total_hh_se, total_persons, total_persons_se, hr, target_hr,
  target_hh, missing_hh from r2 union all
  select end_year, YEAR, 'total', sum(total_hh), sum(total_hh_se), sum(total_persons), sum(total_persons_se),
  cast(sum(total_hh) as double)/sum(total_persons), sum(target_hh)/sum(total_persons), sum(target_hh), sum(missing_hh)
  from r2 group by 1,2)"""
_TARGET_COLS = ("end_year:int YEAR:int age_bin:str total_hh:bigint total_hh_se:d5 total_persons:bigint "
                "total_persons_se:d5 hr:d6 target_hr:d6 target_hh:d4 missing_hh:d4")


def targets(spark, sf_dir, end_years):
    return target_rates.headship_targets(target_rates.person_counts(prepared.banded(spark, sf_dir)), end_years)


@query("D15_target_headship", _TARGET_COLS, "hh pp", f"with {_TARGETS}\nselect * from targets where end_year=1998")
def _(spark, sf_dir):
    return targets(spark, sf_dir, [1998])


@query("D16_sweep_of_end_years", _TARGET_COLS, "hh pp", f"with {_TARGETS}\nselect * from targets")
def _(spark, sf_dir):
    return targets(spark, sf_dir, [1996, 1998, 2000])


@query("D17_total_rate_and_average", "YEAR:int age_bin:str hr:d6", "hh pp",
       f"""with {_TARGETS}, s as (select YEAR, age_bin, hr from targets where end_year=1998 and age_bin='total')
       \nselect * from s union all select y, 'avg', hr from (select unnest(range(1995, 2002)) as y),
       (select avg(hr) as hr from s)""")
def _(spark, sf_dir):
    return target_rates.total_rate_with_average(targets(spark, sf_dir, [1998]), YEARS[0], YEARS[-1])


# --- external projections --------------------------------------------------------------------------

_PROJ = """pb as (select countyfips as area_code, year, case when age<=24 then 1 when age<=44 then 2 when age<=64 then 3
    else 4 end as age_group_id, sum(totalpopulation) as pop from ppop where countyfips=0 and age>=18 group by 1,2,3),
pa as (select * from pb union all select area_code, year, 0, sum(pop) from pb group by 1,2),
proj as (select ph.area_code, ph.year, ph.age_group_id, age_group_description as age_group, total_households as hh, pop,
    cast(total_households as double)/pop as headship_rate
  from ph left join pa on ph.area_code=pa.area_code and ph.year=pa.year and ph.age_group_id=pa.age_group_id
  where ph.area_code=0 and household_type_id=0)"""


def projected(spark, sf_dir):
    return projections.projected_headship(views.projection_households(spark, sf_dir),
                                          views.projection_population(spark, sf_dir))


@query("D18_projected_headship", "area_code:int year:int age_group_id:int age_group:str hh:bigint pop:bigint "
       "headship_rate:d6", "pp ph ppop", f"with {_PROJ}\nselect * from proj")
def _(spark, sf_dir):
    return projected(spark, sf_dir)


_SURVEYED = f"""{_BANDED},
tp as (select YEAR, age_group_id, sum(PERWT) as pop, {se(PW, PR)} as pop_se from banded group by 1,2 union all
  select YEAR, 0, sum(PERWT), {se(PW, PR)} from banded group by 1),
th as (select YEAR, age_group_id, sum(PERWT) as hh, {se(PW, PR)} as hh_se from banded where PERNUM=1 group by 1,2 union all
  select YEAR, 0, sum(PERWT), {se(PW, PR)} from banded where PERNUM=1 group by 1),
surv as (select tp.YEAR as year, tp.age_group_id, pop, pop_se, hh, hh_se, cast(hh as double)/pop as headship_rate
  from tp left join th on tp.YEAR=th.YEAR and tp.age_group_id=th.age_group_id where tp.age_group_id is not null)"""


@query("D19_survey_headship_by_band", "year:int age_group_id:int pop:bigint pop_se:d5 hh:bigint hh_se:d5 "
       "headship_rate:d6", "hh pp", f"with {_SURVEYED}\nselect * from surv")
def _(spark, sf_dir):
    return projections.surveyed_headship(prepared.banded(spark, sf_dir))


@query("D19_survey_against_projection", "year:int age_group_id:int age_group:str pop_survey:bigint pop_se:d5 "
       "pop_projected:bigint pop_diff:bigint check_pop:bool hh_survey:bigint hh_se:d5 headship_rate_survey:d6 "
       "headship_rate_projected:d6", "hh pp ph ppop",
       f"""with {_SURVEYED}, {_PROJ}
       \nselect coalesce(s.year, p.year) as year, coalesce(s.age_group_id, p.age_group_id) as age_group_id, age_group,
       s.pop as pop_survey, pop_se, p.pop as pop_projected, s.pop-p.pop as pop_diff,
       abs(s.pop-p.pop)<=pop_se as check_pop, s.hh as hh_survey, hh_se, s.headship_rate as headship_rate_survey,
       p.headship_rate as headship_rate_projected
       from surv s full join proj p on s.year=p.year and s.age_group_id=p.age_group_id""")
def _(spark, sf_dir):
    return projections.comparison(projections.surveyed_headship(prepared.banded(spark, sf_dir)),
                                  projected(spark, sf_dir))


@query("S4_labels_attached_after_sums", "msa:str n:bigint", "hh lab",
       f"with {UNITS}\nselect msa, sum(HHWT) as n from units group by 1")
def _(spark, sf_dir):
    """Labels of a dictionary variable attached to sums instead of records."""
    sums = prepared.units(spark, sf_dir).groupBy("MET2013").agg(F.sum("HHWT").alias("w"))
    named = housing.attach_area(sums, value_labels(views.dictionary(spark, sf_dir), "MET2013"))
    return named.groupBy("msa").agg(F.sum("w").alias("n"))
