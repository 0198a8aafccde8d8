"""SQL text shared by the oracles: the prepared tables, written independently of the library."""

# Units outside institutions with their flags.
UNITS = """units as (
  select hh.*, lbl as msa, VACANCY=4 as SEASONAL,
    (KITCHEN=1 or PLUMBING=10) and case when VACDUR is null then VACANCY in (1,2,3) else VACDUR>=7 end
      as UNINHABITABLE,
    VACANCY in (1,2,3) as VACAVAIL, VACANCY<>0 as VACANT
  from hh left join lab on MET2013 is not distinct from val
  where not coalesce(GQ in (3,4), false))"""

# Five-year age group by integer arithmetic.
AGEGROUP = """case when AGE>=65 then '[65,Inf]' when AGE<15 then '[0,15)'
  else '[' || cast(AGE//5*5 as varchar) || ',' || cast(AGE//5*5+5 as varchar) || ')' end"""

DEFL = """yearly as (select year(observation_date) as YEAR, avg(CPIAUCSL) as cpi from cpi group by 1),
defl as (select YEAR, cpi, (select cpi from yearly where YEAR=1999)/cpi as adj_factor from yearly)"""

# Persons in households with recoded columns in real money.
PEOPLE = f"""people0 as (
  select pp.*, u.STATEFIP, u.MET2013, u.msa, u.PUMA, u.GQ, u.OWNERSHP, u.HHWT, u.RENTGRS,
    case when u.HHINCOME=9999999 then 0 else u.HHINCOME end as HHINC0,
    case when u.OWNCOST=99999 then 0 else u.OWNCOST end as OWNCOST0,
    case when pp.INCTOT=9999999 then null else pp.INCTOT end as INCTOT0,
    RELATE=1 as HEADSHIP, {AGEGROUP} as AGEGROUP, AGE>=18 and AGE<45 as age_dummy
  from units u right join pp on u.YEAR=pp.YEAR and u.SERIAL=pp.SERIAL
    and u.CBSERIAL is not distinct from pp.CBSERIAL and u.SAMPLE=pp.SAMPLE
  where u.GQ in (0,1,2,5)),
people1 as (
  select *, case when OWNERSHP=1 then OWNCOST0 when OWNERSHP=2 then RENTGRS end as COST0,
    case when INCTOT0 is null and AGE<=15 then 0 else INCTOT0 end as INCTOT1 from people0),
people as (
  select people1.* exclude (INCTOT, FTOTINC), defl.adj_factor,
    case when COST0*adj_factor<1 then 1 else COST0*adj_factor end as HOUSINGCOST,
    HHINC0*adj_factor as HHINCOME,
    case when INCTOT1*adj_factor<1 then 1 else INCTOT1*adj_factor end as INCTOT,
    people1.FTOTINC*adj_factor as FTOTINC,
    case when COST0*adj_factor<1 then 1 else COST0*adj_factor end
      / (case when INCTOT1*adj_factor<1 then 1 else INCTOT1*adj_factor end) * 12 as HCOSTRATIO
  from people1 left join defl on people1.YEAR=defl.YEAR)"""


def se(weight: str, replicates: list[str]) -> str:
    """Standard error of a weighted count."""
    terms = "+".join(f"power(cast(sum({r}) as double)-sum({weight}),2)" for r in replicates)
    return f"sqrt(4.0e0/{len(replicates)}*({terms}))"


def strict(x: str) -> str:
    """Sum that is null as soon as one input is."""
    return f"case when count({x})=count(*) then sum({x}) end"
