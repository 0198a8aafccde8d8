"""Sources, projections, filters, joins, sorts, unions, reshaping, windows and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe import functions as fn
from tallyframe.operators import (
    across, full_join, group_share, keyed_join, longer, matching, natural_join, relocate, union_fill,
    wider, with_missing_years,
)
from tallyframe.plans import codes, housing, people, prices, projections, vacancy
from tallyframe.session import belonging, scratch_path, stage
from tallyframe.sources import (
    Field, landed_or, malformed_fields, read_csv, read_dictionary, read_hierarchical, read_rectangular, read_table,
    text_labels, value_labels, write_csv,
)
from tallyframe.workload import views
from tallyframe.workload.registry import query
from tallyframe.workload.sqltext import AGEGROUP, DEFL, UNITS
from tallyframe.workload.views import BASE_YEAR, PRICE_YEAR, STATE, YEARS

def units(spark, sf_dir, mode="duration_or_listed") -> DataFrame:
    labelled = housing.attach_area(views.households(spark, sf_dir), views.area_labels(spark, sf_dir))
    return housing.housing_units(labelled, mode)


# --- sources ---------------------------------------------------------------------------------------

_H_LAYOUT = [("YEAR", 4), ("SERIAL", 12), ("GQ", 2), ("VACDUR", 3), ("HHWT", 6)]
_P_LAYOUT = [("YEAR", 4), ("SERIAL", 12), ("PERNUM", 3), ("AGE", 3), ("INCTOT", 9)]


def _fields(layout, kind: str) -> list[Field]:
    out, at = [], 2
    for name, width in layout:
        out.append(Field(name, at, width, rectypes=(kind,)))
        at += width
    return out


def _lines(df: DataFrame, kind: str, layout) -> DataFrame:
    cells = [F.lpad(F.coalesce(F.col(n).cast("string"), F.lit("")), w, " ") for n, w in layout]
    return df.select(F.concat(F.lit(kind), *cells).alias("value"))


_RECTYPE = Field("RECTYPE", 1, 1, text=True)


@query("S1_hierarchical_records_split", "YEAR:int SERIAL:bigint GQ:int VACDUR:int HHWT:int members:bigint "
       "ages:bigint income:bigint", "hh pp",
       """select hh.YEAR, hh.SERIAL, GQ, VACDUR, HHWT, count(pp.SERIAL) as members, sum(AGE) as ages,
       sum(INCTOT) as income from hh left join pp on hh.SERIAL=pp.SERIAL and hh.YEAR=pp.YEAR
       group by 1,2,3,4,5""")
def _(spark, sf_dir):
    """Text files of household and person records in one stream, split by record type and parsed."""
    path = scratch_path(spark, "hierarchical")
    _lines(views.households(spark, sf_dir), "H", _H_LAYOUT).union(
        _lines(views.persons(spark, sf_dir), "P", _P_LAYOUT)).write.text(path)
    h, p = read_hierarchical(spark, path, [_RECTYPE, *_fields(_H_LAYOUT, "H"), *_fields(_P_LAYOUT, "P")])
    per = p.groupBy("YEAR", "SERIAL").agg(F.count("*").alias("members"), F.sum("AGE").alias("ages"),
                                          F.sum("INCTOT").alias("income"))
    return belonging(path, keyed_join(h, per, ["YEAR", "SERIAL"], nullable=()).withColumn(
        "members", F.coalesce("members", F.lit(0))))


@query("S2_rectangular_records", "YEAR:int SERIAL:bigint PERNUM:int AGE:int INCTOT:bigint", "pp",
       "select YEAR, SERIAL, PERNUM, AGE, INCTOT from pp")
def _(spark, sf_dir):
    path = scratch_path(spark, "rectangular")
    _lines(views.persons(spark, sf_dir), "P", _P_LAYOUT).write.text(path)
    return belonging(path, read_rectangular(spark, path, _fields(_P_LAYOUT, "P")))


@query("S2_malformed_fields", "field:str n:bigint", "pp",
       """select 'AGE' as field, count(*) as n from pp where AGE=33 union all
       select 'INCTOT', count(*) from pp where INCTOT=9999999""")
def _(spark, sf_dir):
    """Fields that are not numbers are missing and counted."""
    path = scratch_path(spark, "malformed")
    spoiled = views.persons(spark, sf_dir).withColumns({
        "AGE": F.when(F.col("AGE") == 33, "3x").otherwise(F.col("AGE").cast("string")),
        "INCTOT": F.when(F.col("INCTOT") == 9999999, "99 99").otherwise(F.col("INCTOT").cast("string"))})
    _lines(spoiled, "P", _P_LAYOUT).write.text(path)
    return belonging(path, malformed_fields(spark.read.text(path), _fields(_P_LAYOUT, "P")).filter("n > 0"))


@query("S4_value_labels", "val:int lbl:str units:bigint", "hh dict",
       """select val, lbl, count(hh.SERIAL) as units from dict left join hh on MET2013=val
       where var_name='MET2013' group by 1,2""")
def _(spark, sf_dir):
    """Codes and labels of one variable from a nested dictionary, with the number of records of each."""
    labels = value_labels(views.dictionary(spark, sf_dir), "MET2013")
    n = views.households(spark, sf_dir).groupBy(F.col("MET2013").alias("val")).agg(
        F.count("*").alias("units"))
    return keyed_join(labels, n, ["val"], nullable=()).fillna(0, ["units"])


@query("S3_dictionary_from_codebook", "var_name:str var_label:str start:int width:int labels:int", "dict",
       """select var_name, concat('Label of ', var_name) as var_label, 10 as start, 3 as width,
       count(*) as labels from dict group by 1""")
def _(spark, sf_dir):
    """An XML codebook written from the label tables and read back."""
    path = scratch_path(spark, "codebook")
    views.dictionary(spark, sf_dir).select(
        F.col("var_name").alias("_name"), F.concat(F.lit("Label of "), "var_name").alias("labl"),
        F.struct(F.lit(10).alias("_StartPos"), F.lit(12).alias("_EndPos"), F.lit(3).alias("_width")).alias("location"),
        F.transform("val_labels", lambda v: F.struct(v["val"].alias("catValu"), v["lbl"].alias("labl"))).alias("catgry")
    ).write.format("xml").option("rowTag", "var").option("rootTag", "dataDscr").save(path)
    return belonging(path, read_dictionary(spark, path).withColumn("labels", F.size("val_labels")))


@query("S3_text_categories", "code:str lbl:str", "",
       "select n_name as code, concat('Label of ', n_name) as lbl from nation")
def _(spark, sf_dir):
    """A codebook whose categories are text keeps their codes as text."""
    path = scratch_path(spark, "codebook")
    category = F.struct(F.col("n_name").alias("catValu"), F.concat(F.lit("Label of "), "n_name").alias("labl"))
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy(F.lit("NATION").alias("_name")).agg(
        F.collect_list(category).alias("catgry")).write.format("xml").option("rowTag", "var").option(
        "rootTag", "dataDscr").save(path)
    return belonging(path, text_labels(read_dictionary(spark, path), "NATION"))


_MONEY = "YEAR:int SERIAL:bigint VACDUR:int HHINCOME:int price:d2 day:date"


@query("S5_K1_csv_written_and_read", _MONEY, "hh cpi",
       """select hh.YEAR, SERIAL, VACDUR, HHINCOME, cast(RENTGRS as double)/4 as price,
       cast(concat(cast(hh.YEAR as varchar), '-06-15') as date) as day from hh""")
def _(spark, sf_dir):
    """Delimited files with a header and ``NA`` for missing, written and read back with inferred types."""
    path = scratch_path(spark, "csv")
    hh = views.households(spark, sf_dir)
    write_csv(hh.select("YEAR", "SERIAL", "VACDUR", "HHINCOME", (F.col("RENTGRS").cast("double") / 4).alias("price"),
                        F.make_date("YEAR", F.lit(6), F.lit(15)).alias("day")), path)
    return belonging(path, read_csv(spark, path))


@query("S8_landed_copy_by_year", "YEAR:int n:bigint income:bigint", "hh",
       "select YEAR, count(*) as n, sum(HHINCOME) as income from hh where YEAR>=1997 group by 1")
def _(spark, sf_dir):
    """Records landed by year on first use and read from the landed copy, other years skipped."""
    path = scratch_path(spark, "landed")

    def build():
        return views.households(spark, sf_dir).select("YEAR", "SERIAL", "HHINCOME")

    landed_or(spark, path, build)
    landed = landed_or(spark, path, build)
    return belonging(path, landed.filter("YEAR >= 1997").groupBy("YEAR").agg(F.count("*").alias("n"), F.sum("HHINCOME").alias("income")))


@query("S6_table_scan_pushed", "area_code:int year:int age_group_id:int age_group:str hh:bigint", "ph",
       """select area_code, year, age_group_id, age_group_description as age_group, total_households as hh
       from ph where area_code=0 and household_type_id=0""")
def _(spark, sf_dir):
    """A table written to files, registered, and read with its filters and columns pushed to the scan."""
    path, name = scratch_path(spark, "projection"), f"projection_{uuid.uuid4().hex}"
    views.projection_households(spark, sf_dir).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView(name)
    result = belonging(path, projections.projected_households(read_table(spark, name)))
    # the frame has the table's plan; the name would keep its files
    spark.catalog.dropTempView(name)
    return result


@query("S7_literal_year_table", "YEAR:int n:bigint", "hh",
       """select y as YEAR, count(hh.YEAR) as n from (select unnest(range(1990, 2006)) as y) left join hh
       on y=hh.YEAR group by 1""")
def _(spark, sf_dir):
    """Counts on a literal table of years."""
    counted = views.households(spark, sf_dir).groupBy("YEAR").agg(F.count("*").alias("n"))
    return with_missing_years(counted, "YEAR", 1990, 2005, {"n": 0})


@query("K3_lookup_by_year", "YEAR:int units:bigint base_units:bigint", "hh",
       """with t as (select YEAR, sum(HHWT) as units from hh group by 1)
       \nselect YEAR, units, (select units from t where YEAR=1995) as base_units from t""")
def _(spark, sf_dir):
    """A yearly total beside the total looked up for one year."""
    t = views.households(spark, sf_dir).groupBy("YEAR").agg(F.sum("HHWT").alias("units"))
    base = F.max(F.when(F.col("YEAR") == BASE_YEAR, F.col("units"))).over(Window.partitionBy())
    return t.withColumn("base_units", base)


# --- projections -----------------------------------------------------------------------------------

@query("P1_sequential_columns", "SERIAL:bigint SEASONAL:bool UNINHABITABLE:bool VACAVAIL:bool VACANT:bool",
       "hh lab", f"with {UNITS}\nselect SERIAL, SEASONAL, UNINHABITABLE, VACAVAIL, VACANT from units")
def _(spark, sf_dir):
    return units(spark, sf_dir)


@query("P2_select", "YEAR:int SERIAL:bigint GQ:int", "hh", "select YEAR, SERIAL, GQ from hh")
def _(spark, sf_dir):
    return views.households(spark, sf_dir).select("YEAR", "SERIAL", "GQ")


_KEPT = "YEAR SERIAL CBSERIAL SAMPLE STATEFIP MET2013 PUMA GQ VACANCY VACDUR KITCHEN PLUMBING OWNERSHP"


@query("P3_drop_columns", "YEAR:int SERIAL:bigint kept:str", "hh",
       f"""select YEAR, SERIAL, concat_ws('|', {", ".join(f"coalesce(cast({c} as varchar), '-')" for c in _KEPT.split())}) as kept
       from hh""")
def _(spark, sf_dir):
    """Dropping by name and by pattern: the values of all columns that are left, in their order."""
    hh = views.households(spark, sf_dir)
    left = hh.drop("OWNCOST", "RENTGRS", "HHINCOME", *matching(hh, "^(HHWT|REPWT[0-9]+)$"))
    return left.withColumn("kept", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in left.columns]))


@query("P4_rename", "MET2013:int msa:str", "lab", "select val as MET2013, lbl as msa from lab")
def _(spark, sf_dir):
    return views.area_labels(spark, sf_dir).withColumnsRenamed({"val": "MET2013", "lbl": "msa"})


@query("P5_relocate", "SERIAL:bigint row:str", "hh lab",
       """select SERIAL, concat_ws('|', STATEFIP, coalesce(cast(MET2013 as varchar), '-'), coalesce(lbl, '-'), PUMA) as row
       from hh left join lab on MET2013 is not distinct from val""")
def _(spark, sf_dir):
    """The area name moved behind its code: the values of the fifth to the eighth column in their order."""
    moved = relocate(housing.attach_area(views.households(spark, sf_dir), views.area_labels(spark, sf_dir)),
                     "msa", after="MET2013")
    return moved.select("SERIAL", F.concat_ws("|", *[
        F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in moved.columns[4:8]]).alias("row"))


@query("P6_select_by_pattern", "YEAR:int replicates:int r1:bigint r80:bigint", "hh",
       "select YEAR, 80 as replicates, sum(REPWT1) as r1, sum(REPWT80) as r80 from hh group by 1")
def _(spark, sf_dir):
    hh = views.households(spark, sf_dir)
    reps = matching(hh, "REPWT[0-9]+")
    return hh.groupBy("YEAR").agg(F.lit(len(reps)).alias("replicates"), F.sum(reps[0]).alias("r1"),
                                  F.sum(reps[-1]).alias("r80"))


@query("P7_across_columns", "YEAR:int OWNCOST:bigint RENTGRS:bigint HHINCOME:bigint HHWT:bigint", "hh",
       "select YEAR, sum(OWNCOST) as OWNCOST, sum(RENTGRS) as RENTGRS, sum(HHINCOME) as HHINCOME, "
       "sum(HHWT) as HHWT from hh group by 1")
def _(spark, sf_dir):
    return views.households(spark, sf_dir).groupBy("YEAR").agg(
        *across(["OWNCOST", "RENTGRS", "HHINCOME", "HHWT"], fn.strict_sum))


@query("P8_strip_labels", "code:int n:bigint", "hh", "select GQ as code, count(*) as n from hh group by 1")
def _(spark, sf_dir):
    """Column metadata (labels) removed; values stay."""
    hh = views.households(spark, sf_dir)
    labelled = hh.select(F.col("GQ").alias("code", metadata={"labels": {"1": "household"}}))
    return labelled.select(F.col("code").alias("code", metadata={})).groupBy("code").agg(
        F.count("*").alias("n"))


@query("P9_recode_codes", "SERIAL:bigint VACANCY:int tenure:str", "hh",
       """select SERIAL, case when VACANCY=3 then 0 else VACANCY end as VACANCY,
       case when OWNERSHP=0 then 'Vacant' else cast(OWNERSHP as varchar) end as tenure from hh""")
def _(spark, sf_dir):
    hh = views.households(spark, sf_dir)
    return hh.select("SERIAL", vacancy.recode(F.col("VACANCY"), {3: 0}).alias("VACANCY"),
                     F.when(F.col("OWNERSHP") == 0, "Vacant").otherwise(F.col("OWNERSHP").cast("string"))
                     .alias("tenure"))


@query("P10_codes_as_categories", "category:str position:int n:bigint", "hh",
       "select cast(VACANCY as varchar) as category, VACANCY+1 as position, count(*) as n from hh group by 1,2")
def _(spark, sf_dir):
    """Codes as categories ordered by code."""
    n = views.households(spark, sf_dir).groupBy("VACANCY").agg(F.count("*").alias("n"))
    return n.select(F.col("VACANCY").cast("string").alias("category"),
                    F.row_number().over(Window.orderBy("VACANCY")).alias("position"), "n")


# --- filters ---------------------------------------------------------------------------------------

@query("F1_membership", "SERIAL:bigint GQ:int", "hh", "select SERIAL, GQ from hh where GQ in (0,1,2,5)")
def _(spark, sf_dir):
    return views.households(spark, sf_dir).filter(fn.in_set(F.col("GQ"), (0, 1, 2, 5)))


@query("F2_negated_membership_keeps_missing", "SERIAL:bigint VACDUR:int", "hh",
       "select SERIAL, VACDUR from hh where VACDUR is null or VACDUR not in (3,4)")
def _(spark, sf_dir):
    return views.households(spark, sf_dir).filter(fn.not_in_set(F.col("VACDUR"), (3, 4)))


@query("F3_comparisons", "SERIAL:bigint PERNUM:int AGE:int", "pp",
       "select SERIAL, PERNUM, AGE from pp where AGE>=15 and (YEAR=1995 or YEAR=1999)")
def _(spark, sf_dir):
    year = F.col("YEAR")
    return views.persons(spark, sf_dir).filter((F.col("AGE") >= 15) & ((year == 1995) | (year == 1999)))


@query("F4_negated_flags", "SERIAL:bigint VACANCY:int", "hh lab",
       f"with {UNITS}\nselect SERIAL, VACANCY from units where not (SEASONAL or UNINHABITABLE)")
def _(spark, sf_dir):
    return housing.in_use(units(spark, sf_dir))


@query("F5_present", "SERIAL:bigint tenure:str", "hh",
       """select SERIAL, tenure from (select SERIAL, case VACANCY when 1 then 'rent' when 2 then 'own' end
       as tenure from hh) where tenure is not null""")
def _(spark, sf_dir):
    tenure = vacancy.tenure_of_vacant(F.col("VACANCY"))
    return views.households(spark, sf_dir).withColumn("tenure", tenure).filter(F.col("tenure").isNotNull())


@query("F6_age_range", "SERIAL:bigint PERNUM:int age_dummy:bool", "pp",
       "select SERIAL, PERNUM, AGE>=18 and AGE<45 as age_dummy from pp where AGE between 15 and 65")
def _(spark, sf_dir):
    p = views.persons(spark, sf_dir).filter(F.col("AGE").between(15, 65))
    return people.with_headship(p, 18, 45)


@query("F7_nonzero_weight", "SERIAL:bigint PERNUM:int REPWTP1:int", "pp",
       "select SERIAL, PERNUM, REPWTP1 from pp where REPWTP1<>0")
def _(spark, sf_dir):
    return views.persons(spark, sf_dir).filter(F.col("REPWTP1") != 0)


@query("F8_sample_name_pattern", "name:str n:bigint", "hh",
       """select name, count(*) as n from (select concat('us', cast(YEAR as varchar),
       case when YEAR%2=1 then 'a' else 'b' end) as name from hh)
       where regexp_matches(name, 'us(19|20)[0-9]{2}a') group by 1""")
def _(spark, sf_dir):
    name = F.concat(F.lit("us"), F.col("YEAR").cast("string"),
                    F.when(F.col("YEAR") % 2 == 1, "a").otherwise("b"))
    return (views.households(spark, sf_dir).groupBy(name.alias("name")).agg(F.count("*").alias("n"))
            .filter(F.col("name").rlike(r"us(19|20)\d{2}a")))


# --- joins -----------------------------------------------------------------------------------------

@query("J1_label_lookup", "SERIAL:bigint MET2013:int msa:str", "hh lab",
       "select SERIAL, MET2013, lbl as msa from hh left join lab on MET2013 is not distinct from val")
def _(spark, sf_dir):
    return housing.attach_area(views.households(spark, sf_dir), views.area_labels(spark, sf_dir))


@query("J2_household_to_person", "YEAR:int SERIAL:bigint PERNUM:int GQ:int MET2013:int AGE:int", "hh pp lab",
       f"""with {UNITS}
       \nselect pp.YEAR, pp.SERIAL, PERNUM, GQ, MET2013, AGE from units u right join pp on u.YEAR=pp.YEAR
       and u.SERIAL=pp.SERIAL and u.CBSERIAL=pp.CBSERIAL and u.SAMPLE=pp.SAMPLE where GQ in (0,1,2,5)""")
def _(spark, sf_dir):
    return people.household_members(housing.housing_units(views.households(spark, sf_dir)),
                                    views.persons(spark, sf_dir))


@query("J3_household_attribute", "SERIAL:bigint PERNUM:int GQ:int", "hh pp",
       """select pp.SERIAL, PERNUM, GQ from pp left join (select YEAR, SERIAL, GQ from hh where VACANCY<4) h
       on pp.YEAR=h.YEAR and pp.SERIAL=h.SERIAL""")
def _(spark, sf_dir):
    quarters = views.households(spark, sf_dir).filter("VACANCY<4").select("YEAR", "SERIAL", "GQ")
    return views.persons(spark, sf_dir).join(quarters, ["YEAR", "SERIAL"], "left")


@query("J4_year_dimension", "SERIAL:bigint cpi:d6 adj_factor:d6", "hh cpi",
       f"with {DEFL}\nselect SERIAL, cpi, adj_factor from hh left join defl on hh.YEAR=defl.YEAR")
def _(spark, sf_dir):
    d = prices.deflator(views.cpi(spark, sf_dir), PRICE_YEAR)
    return views.households(spark, sf_dir).join(F.broadcast(d), "YEAR", "left")


@query("J6_chained_natural_joins", "YEAR:int msa:str a:bigint b:bigint c:bigint", "hh lab",
       f"""with {UNITS},
       a as (select YEAR, msa, sum(HHWT) as a from units group by 1,2),
       b as (select YEAR, msa, sum(HHWT) as b from units where SEASONAL group by 1,2),
       c as (select YEAR, msa, sum(HHWT) as c from units where UNINHABITABLE group by 1,2)
       \nselect a.YEAR, a.msa, a, b, c from a left join b on a.YEAR=b.YEAR and a.msa is not distinct from b.msa
       left join c on a.YEAR=c.YEAR and a.msa is not distinct from c.msa""")
def _(spark, sf_dir):
    """Aggregates joined one after another on their common columns, missing area matching missing."""
    kinds = ("SEASONAL", "UNINHABITABLE")
    # the units are read once; the joined tables are parts of their few sums
    sums = stage(units(spark, sf_dir).groupBy("YEAR", "msa", *kinds).agg(F.sum("HHWT").alias("w")))

    def total(rows, name):
        return rows.groupBy("YEAR", "msa").agg(F.sum("w").alias(name))

    out = total(sums, "a")
    for name, cond in zip("bc", kinds):
        out = natural_join(out, total(sums.filter(cond), name))
    return out


@query("J7_composite_key", "YEAR:int tenure:str vac:bigint occ:bigint", "hh",
       """select v.YEAR, v.tenure, vac, occ from
       (select YEAR, case VACANCY when 1 then 'rent' when 2 then 'own' end as tenure, sum(HHWT) as vac
        from hh where VACANCY in (1,2) group by 1,2) v left join
       (select YEAR, case OWNERSHP when 2 then 'rent' when 1 then 'own' end as tenure, sum(HHWT) as occ
        from hh where OWNERSHP in (1,2) group by 1,2) o on v.YEAR=o.YEAR and v.tenure=o.tenure""")
def _(spark, sf_dir):
    hh = views.households(spark, sf_dir)

    def by(tenure, name):
        return hh.withColumn("tenure", tenure).filter(F.col("tenure").isNotNull()).groupBy(
            "YEAR", "tenure").agg(F.sum("HHWT").alias(name))

    return keyed_join(by(vacancy.tenure_of_vacant(F.col("VACANCY")), "vac"),
                      by(vacancy.tenure_of_occupied(F.col("OWNERSHP")), "occ"), ["YEAR", "tenure"])


@query("J8_natural_join", "YEAR:int MET2013:int hh:bigint pop:bigint", "hh",
       """select a.YEAR, a.MET2013, hh, pop from
       (select YEAR, MET2013, count(*) as hh from hh where VACANCY=0 group by 1,2) a left join
       (select YEAR, MET2013, sum(HHWT) as pop from hh group by 1,2) b
       on a.YEAR=b.YEAR and a.MET2013 is not distinct from b.MET2013""")
def _(spark, sf_dir):
    hh = views.households(spark, sf_dir)
    return natural_join(hh.filter("VACANCY=0").groupBy("YEAR", "MET2013").agg(F.count("*").alias("hh")),
                        hh.groupBy("YEAR", "MET2013").agg(F.sum("HHWT").alias("pop")))


@query("J9_full_join_suffixes", "year:int age:int pop_survey:bigint pop_projected:bigint", "pp ppop",
       """select coalesce(a.year, b.year) as year, coalesce(a.age, b.age) as age, a.pop as pop_survey,
       b.pop as pop_projected from (select YEAR as year, AGE as age, sum(PERWT) as pop from pp group by 1,2) a
       full join (select year, age, totalpopulation as pop from ppop) b on a.year=b.year and a.age=b.age""")
def _(spark, sf_dir):
    survey = views.persons(spark, sf_dir).groupBy(F.col("YEAR").alias("year"), F.col("AGE").alias("age")).agg(
        F.sum("PERWT").alias("pop"))
    projected = views.projection_population(spark, sf_dir).select(
        "year", "age", F.col("totalpopulation").alias("pop"))
    return full_join(survey, projected, ["year", "age"], ("_survey", "_projected"))


@query("J11_join_to_union", "VACANCY:int units:bigint target:bigint", "hh",
       """select a.VACANCY, units, target from (select VACANCY, sum(HHWT) as units from hh group by 1) a
       left join (select VACANCY, sum(HHWT) as target from hh where VACANCY<2 and GQ=0 group by 1
       union all select VACANCY, count(*) from hh where VACANCY>=4 group by 1) b on a.VACANCY=b.VACANCY""")
def _(spark, sf_dir):
    hh = views.households(spark, sf_dir)
    young = hh.filter("VACANCY<2 and GQ=0").groupBy("VACANCY").agg(F.sum("HHWT").alias("target"))
    rest = hh.filter("VACANCY>=4").groupBy("VACANCY").agg(F.count("*").alias("target"))
    return keyed_join(hh.groupBy("VACANCY").agg(F.sum("HHWT").alias("units")), union_fill(young, rest),
                      ["VACANCY"])


@query("J12_years_with_one_row_aggregate", "YEAR:int hr:d6", "hh",
       """select y as YEAR, hr from (select unnest(range(1995, 2002)) as y),
       (select avg(HHINCOME) as hr from hh)""")
def _(spark, sf_dir):
    """A one-row aggregate repeated for every year of a range, without joining rows to rows."""
    mean = views.households(spark, sf_dir).agg(fn.strict_mean(F.col("HHINCOME")).alias("hr"))
    return mean.select(F.explode(F.sequence(F.lit(YEARS[0]), F.lit(YEARS[-1]))).alias("YEAR"), "hr")


@query("J13_all_against_subset", "VACANCY:int everywhere:bigint here:bigint", "hh",
       """select a.VACANCY, everywhere, here from (select VACANCY, sum(HHWT) as everywhere from hh group by 1) a
       left join (select VACANCY, sum(HHWT) as here from hh where STATEFIP=8 group by 1) b
       on a.VACANCY=b.VACANCY""")
def _(spark, sf_dir):
    """Two aggregates side by side from one pass."""
    return views.households(spark, sf_dir).groupBy("VACANCY").agg(
        F.sum("HHWT").alias("everywhere"),
        F.sum(F.when(F.col("STATEFIP") == STATE, F.col("HHWT"))).alias("here"))


# --- windows ---------------------------------------------------------------------------------------

@query("W1_share_of_total", "VACANCY:int share:d6", "hh",
       """select VACANCY, cast(sum(HHWT) as double)/sum(sum(HHWT)) over ()*100 as share from hh group by 1""")
def _(spark, sf_dir):
    return group_share(views.households(spark, sf_dir).groupBy("VACANCY").agg(F.sum("HHWT").alias("n")), "n")


@query("W2_share_in_group", "YEAR:int OWNERSHP:int share:d6", "hh",
       """select YEAR, OWNERSHP, cast(sum(HHWT) as double)/sum(sum(HHWT)) over (partition by YEAR)*100 as share
       from hh group by 1,2""")
def _(spark, sf_dir):
    return group_share(views.households(spark, sf_dir).groupBy("YEAR", "OWNERSHP").agg(
        F.sum("HHWT").alias("n")), "n", ["YEAR"])


@query("W3_group_mean", "YEAR:int OWNERSHP:int avg_cost:d6", "hh",
       """select YEAR, OWNERSHP, avg(c) over (partition by OWNERSHP) as avg_cost from
       (select YEAR, OWNERSHP, avg(RENTGRS) as c from hh group by 1,2)""")
def _(spark, sf_dir):
    t = views.households(spark, sf_dir).groupBy("YEAR", "OWNERSHP").agg(F.avg("RENTGRS").alias("c"))
    return t.withColumn("avg_cost", vacancy.strict_mean_over(F.col("c"), Window.partitionBy("OWNERSHP")))


@query("W4_conditional_group_mean", "YEAR:int OWNERSHP:int avg_cost:d6", "hh",
       """select YEAR, OWNERSHP, avg(c) filter (where YEAR<=1998) over (partition by OWNERSHP) as avg_cost from
       (select YEAR, OWNERSHP, avg(RENTGRS) as c from hh group by 1,2)""")
def _(spark, sf_dir):
    t = views.households(spark, sf_dir).groupBy("YEAR", "OWNERSHP").agg(F.avg("RENTGRS").alias("c"))
    early = F.avg(F.when(F.col("YEAR") <= 1998, F.col("c")))
    return t.withColumn("avg_cost", early.over(Window.partitionBy("OWNERSHP")))


@query("W5_row_number", "var_name:str val:int row:int", "dict",
       "select var_name, val, row_number() over (partition by var_name order by val) as row from dict")
def _(spark, sf_dir):
    """Labels numbered within their variable; a variable has a handful of codes."""
    flat = views.dictionary(spark, sf_dir).select("var_name", F.inline("val_labels"))
    return flat.withColumn("row", F.row_number().over(Window.partitionBy("var_name").orderBy("val")))


@query("W6_year_on_year", "YEAR:int HU:bigint DELTA:bigint", "hh",
       "select YEAR, sum(HHWT) as HU, sum(HHWT)-lag(sum(HHWT)) over (order by YEAR) as DELTA from hh group by 1")
def _(spark, sf_dir):
    t = views.households(spark, sf_dir).groupBy("YEAR").agg(F.sum("HHWT").alias("HU"))
    return t.withColumn("DELTA", F.col("HU") - F.lag("HU").over(Window.orderBy("YEAR")))


@query("W7_base_period_value", "YEAR:int adj_factor:d6", "cpi", f"with {DEFL}\nselect YEAR, adj_factor from defl")
def _(spark, sf_dir):
    return prices.deflator(views.cpi(spark, sf_dir), PRICE_YEAR)


# --- sort, union, reshape --------------------------------------------------------------------------

@query("O1_sort_missing_last", "place:int YEAR:int msa:str n:bigint", "hh lab",
       f"""with {UNITS}
       \nselect row_number() over (order by YEAR, msa nulls last) as place, YEAR, msa, n
       from (select YEAR, msa, count(*) as n from units group by 1,2)""")
def _(spark, sf_dir):
    """Sorted rows written as delimited files: their order in the files is the place compared."""
    path = scratch_path(spark, "sorted")
    n = units(spark, sf_dir).groupBy("YEAR", "msa").agg(F.count("*").alias("n"))
    write_csv(n.orderBy(F.asc_nulls_last("YEAR"), F.asc_nulls_last("msa")), path)
    lines = read_csv(spark, path, "YEAR int, msa string, n long").withColumn("file", F.input_file_name()).withColumn(
        "line", F.monotonically_increasing_id())
    return belonging(path, lines.withColumn("place", F.row_number().over(Window.orderBy("file", "line"))))


@query("K2_staged_result_used_twice", "YEAR:int units:bigint share:d9", "hh",
       """with t as (select YEAR, sum(HHWT) as units from hh group by 1)
       \nselect YEAR, units, cast(units as double)/(select sum(units) from t) as share from t""")
def _(spark, sf_dir):
    """A staged table read twice: the yearly sums, and their total joined back."""
    t = stage(views.households(spark, sf_dir).groupBy("YEAR").agg(F.sum("HHWT").alias("units")))
    whole = t.agg(F.sum("units").alias("all_units")).withColumn("one", F.lit(1))
    return t.withColumn("one", F.lit(1)).join(whole, "one").withColumn("share", fn.ratio(F.col("units"), F.col("all_units")))


@query("U1_union_by_name", "YEAR:int GQ:int VACANCY:int n:bigint", "hh",
       """select YEAR, GQ, cast(null as int) as VACANCY, count(*) as n from hh group by 1,2
       union all select YEAR, null, VACANCY, count(*) from hh group by 1,3""")
def _(spark, sf_dir):
    hh = views.households(spark, sf_dir)
    return union_fill(hh.groupBy("YEAR", "GQ").agg(F.count("*").alias("n")),
                      hh.groupBy("YEAR", "VACANCY").agg(F.count("*").alias("n")))


@query("U2_missing_years_as_zero", "YEAR:int n:bigint", "hh lab",
       f"""with {UNITS}
       \nselect y as YEAR, coalesce(sum(HHWT),0) as n from (select unnest(range(1992, 2004)) as y) left join
       (select * from units where UNINHABITABLE) u on y=u.YEAR group by 1""")
def _(spark, sf_dir):
    n = units(spark, sf_dir).filter("UNINHABITABLE").groupBy("YEAR").agg(fn.sum0(F.col("HHWT")).alias("n"))
    return with_missing_years(n, "YEAR", 1992, 2003, {"n": 0}).orderBy("YEAR")


@query("R1_wide_by_year", "VACANCY:int " + " ".join(f"{y}:bigint" for y in YEARS), "hh",
       "select VACANCY, " + ", ".join(f'sum(case when YEAR={y} then HHWT end) as "{y}"' for y in YEARS)
       + " from hh group by 1")
def _(spark, sf_dir):
    t = views.households(spark, sf_dir).groupBy("VACANCY", "YEAR").agg(F.sum("HHWT").alias("n"))
    return wider(t, ["VACANCY"], "YEAR", YEARS, "n")


@query("R2_wide_with_templated_names", "row:int MET2013_val:int MET2013_lbl:str REGION_val:int REGION_lbl:str",
       "dict", """with n as (select *, row_number() over (partition by var_name order by val) as row from dict)
       \nselect row, max(case when var_name='MET2013' then val end) as MET2013_val,
       max(case when var_name='MET2013' then lbl end) as MET2013_lbl,
       max(case when var_name='REGION' then val end) as REGION_val,
       max(case when var_name='REGION' then lbl end) as REGION_lbl from n group by 1""")
def _(spark, sf_dir):
    flat = views.dictionary(spark, sf_dir).select("var_name", F.inline("val_labels"))
    numbered = flat.withColumn("row", F.row_number().over(Window.partitionBy("var_name").orderBy("val")))
    return wider(numbered, ["row"], "var_name", ["MET2013", "REGION"], ["val", "lbl"])


@query("R3_long_form", "YEAR:int variable:str value:d6", "hh",
       """select YEAR, 'vac' as variable, sum(case when VACANCY<>0 then HHWT end) as value from hh group by 1
       union all select YEAR, 'rent', avg(RENTGRS) from hh group by 1""")
def _(spark, sf_dir):
    t = views.households(spark, sf_dir).groupBy("YEAR").agg(
        F.sum(F.when(F.col("VACANCY") != 0, F.col("HHWT"))).alias("vac"), F.avg("RENTGRS").alias("rent"))
    return longer(t, ["YEAR"], ["vac", "rent"], "variable", "value")


@query("R4_unnest_labels", "var_name:str val:int lbl:str", "dict", "select var_name, val, lbl from dict")
def _(spark, sf_dir):
    return views.dictionary(spark, sf_dir).select("var_name", F.inline("val_labels"))


# --- scalar functions ------------------------------------------------------------------------------

@query("X1_left_closed_bins", "SERIAL:bigint PERNUM:int AGEGROUP:str bin:int wide:str", "pp",
       f"""select SERIAL, PERNUM, {AGEGROUP} as AGEGROUP,
       case when AGE>=65 then 12 when AGE<15 then 1 else AGE//5-1 end as bin,
       case when AGE>=85 then '[85,Inf]' when AGE<15 then '[0,15)'
         else '[' || cast(AGE//5*5 as varchar) || ',' || cast(AGE//5*5+5 as varchar) || ')' end as wide
       from pp""")
def _(spark, sf_dir):
    age = F.col("AGE")
    return views.persons(spark, sf_dir).select(
        "SERIAL", "PERNUM", people.age_group(age).alias("AGEGROUP"), people.age_group_id(age).alias("bin"),
        people.age_group(age, fn.age_breaks(85)).alias("wide"))


@query("X2_open_bins", "SERIAL:bigint PERNUM:int age_bin:str", "pp",
       """select SERIAL, PERNUM, case when AGE>=65 then '[65,Inf)' when AGE<15 then null
       else '[' || cast(AGE//5*5 as varchar) || ',' || cast(AGE//5*5+5 as varchar) || ')' end as age_bin from pp""")
def _(spark, sf_dir):
    return views.persons(spark, sf_dir).withColumn(
        "age_bin", fn.cut(F.col("AGE"), fn.age_breaks(65, lowest=None), right=False))


@query("X3_right_closed_codes", "SERIAL:bigint PERNUM:int age_group_id:int", "pp",
       """select SERIAL, PERNUM, case when AGE<18 then null when AGE<=24 then 1 when AGE<=44 then 2
       when AGE<=64 then 3 else 4 end as age_group_id from pp""")
def _(spark, sf_dir):
    return views.persons(spark, sf_dir).withColumn(
        "age_group_id", fn.cut_id(F.col("AGE"), codes.PROJECTION_BANDS, include_lowest=True))


@query("X4_labelled_bins", "SERIAL:bigint burden:str", "hh",
       """select SERIAL, case when r<=0 then null when r<=0.35 then '0-35%' when r<=0.6 then '35-60%'
       else '>60%' end as burden from (select SERIAL, cast(RENTGRS as double)/2000 as r from hh)""")
def _(spark, sf_dir):
    ratio = F.col("RENTGRS").cast("double") / 2000
    return views.households(spark, sf_dir).withColumn(
        "burden", fn.cut(ratio, codes.BURDEN_BREAKS, labels=codes.BURDEN_LABELS))


@query("X5_choice_with_missing_condition", "SERIAL:bigint spell:str", "hh",
       """select SERIAL, case when VACDUR is null then null when VACDUR>=7 then 'long' else 'short' end as spell
       from hh""")
def _(spark, sf_dir):
    return views.households(spark, sf_dir).withColumn(
        "spell", fn.if_else(F.col("VACDUR") >= 7, F.lit("long"), F.lit("short")))


@query("X6_multi_branch", "SERIAL:bigint HOUSINGTYPE:str", "hh lab",
       f"""with {UNITS}
       \nselect SERIAL, case when SEASONAL then 'Seasonal' when UNINHABITABLE then 'Uninhabitable'
       else 'Remaining' end as HOUSINGTYPE from units""")
def _(spark, sf_dir):
    return units(spark, sf_dir).withColumn("HOUSINGTYPE", housing.housing_type())


@query("X7_missing_test_and_fill", "SERIAL:bigint unknown:bool VACDUR:int", "hh",
       "select SERIAL, VACDUR is null as unknown, coalesce(VACDUR, 0) as VACDUR from hh")
def _(spark, sf_dir):
    hh = views.households(spark, sf_dir).withColumn("unknown", F.col("VACDUR").isNull())
    return hh.fillna(0, ["VACDUR"])


@query("X8_year_of_date", "observation_date:date YEAR:int", "cpi",
       "select observation_date, year(observation_date) as YEAR from cpi")
def _(spark, sf_dir):
    return views.cpi(spark, sf_dir).withColumn("YEAR", F.year("observation_date"))


@query("X9_regex_predicate", "n_name:str hit:bool", "", "select n_name, regexp_matches(n_name, '^[A-M].*A$') as hit from nation")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("hit", F.col("n_name").rlike("^[A-M].*A$"))


@query("X10_percent_text", "VACANCY:int share:str", "hh",
       """select VACANCY, printf('%.2f%%', cast(sum(HHWT) as double)/sum(sum(HHWT)) over ()*100) as share
       from hh group by 1""")
def _(spark, sf_dir):
    t = views.households(spark, sf_dir).groupBy("VACANCY").agg(F.sum("HHWT").alias("n"))
    return group_share(t, "n").withColumn("share", fn.percent_text(F.col("share")))


@query("X10_percent_text_of_ties", "SERIAL:bigint share:str", "hh",
       """select SERIAL, printf('%.2f%%', x) as share from (select SERIAL, case SERIAL%5 when 0 then 0.125e0 when 1 then 1.005e0
       when 2 then 2.675e0 when 3 then -HHINCOME/8.0e0 else HHWT/1000.0e0 end as x from hh)""")
def _(spark, sf_dir):
    """Ties, and numbers that only look like ties."""
    k = F.col("SERIAL") % 5
    x = (F.when(k == 0, 0.125).when(k == 1, 1.005).when(k == 2, 2.675).when(k == 3, -F.col("HHINCOME") / 8.0)
         .otherwise(F.col("HHWT") / 1000.0))
    return views.households(spark, sf_dir).withColumn("share", fn.percent_text(x))


@query("X11_title_case", "r_name:str title:str", "",
       "select r_name, concat(upper(substr(r_name,1,1)), lower(substr(r_name,2))) as title from region "
       "where strpos(r_name,' ')=0 union all select r_name, 'Middle East' from region where strpos(r_name,' ')>0")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/region.parquet").withColumn("title", F.initcap(F.lower("r_name")))


@query("X12_log_abs_round", "SERIAL:bigint lg:d9 ab:int rd:d1", "pp",
       "select SERIAL, ln(FTOTINC+1.0e0) as lg, abs(INCTOT-20000) as ab, round_even(INCTOT/10.0e0, 0) as rd from pp")
def _(spark, sf_dir):
    p = views.persons(spark, sf_dir)
    return p.select("SERIAL", F.log(F.col("FTOTINC") + 1.0).alias("lg"), F.abs(F.col("INCTOT") - 20000).alias("ab"),
                    fn.round_half_even(F.col("INCTOT") / 10.0).alias("rd"))


@query("X13_casts", "SERIAL:bigint year_text:str head:int", "pp",
       "select SERIAL, cast(YEAR as varchar) as year_text, cast(RELATE=1 as int) as head from pp")
def _(spark, sf_dir):
    return views.persons(spark, sf_dir).select("SERIAL", F.col("YEAR").cast("string").alias("year_text"),
                                               fn.flag(F.col("RELATE") == 1).alias("head"))


@query("X14_condition_in_arithmetic", "SERIAL:bigint occupied:bigint long_vacant:bigint", "hh",
       "select SERIAL, HHWT*cast(VACANCY=0 as int) as occupied, HHWT*cast(VACDUR>=7 as int) as long_vacant from hh")
def _(spark, sf_dir):
    w = F.col("HHWT")
    return views.households(spark, sf_dir).select(
        "SERIAL", (w * fn.flag(F.col("VACANCY") == 0)).alias("occupied"),
        (w * fn.flag(F.col("VACDUR") >= 7)).alias("long_vacant"))


@query("X15_floor_at_one", "SERIAL:bigint VACDUR:int INCOME:int", "hh",
       """select SERIAL, case when VACDUR<1 then 1 else VACDUR end as VACDUR,
       case when HHINCOME-100000<1 then 1 else HHINCOME-100000 end as INCOME from hh""")
def _(spark, sf_dir):
    return views.households(spark, sf_dir).select(
        "SERIAL", fn.floor_at_one(F.col("VACDUR")).alias("VACDUR"),
        fn.floor_at_one(F.col("HHINCOME") - 100000).alias("INCOME"))
