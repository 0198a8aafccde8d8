"""Model-based counterfactuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import functions as fn
from tallyframe.operators import LogitSpec, fit_formula, keyed_join, longer
from tallyframe.operators.logit import predict_formula, predicted
from tallyframe.plans import counterfactual as cf
from tallyframe.session import stage
from tallyframe.workload import prepared
from tallyframe.workload.registry import query
from tallyframe.workload.sqltext import DEFL, PEOPLE, UNITS, strict
from tallyframe.workload.survey import _median_sql
from tallyframe.workload.views import BASE_YEAR, STATE, VACANCY_RATE, YEARS

MODEL_MIN_AGE, MODEL_MAX_AGE = 20, 199
AGES = (MODEL_MIN_AGE, MODEL_MAX_AGE)
NOW = 1999
BASE = next(m for m in cf.MODELS if m.name == "base")
_USES = "hh pp lab cpi"

# Model rows of the state.
_ROWS = f"""{UNITS}, {DEFL}, {PEOPLE},
rows as (select YEAR, AGE, AGEGROUP, PERWT, NCHILD, HCOSTRATIO, cast(HEADSHIP as int) as HEADSHIP,
  cast(MARST in (1,2) as int) as MARRIED, cast(LABFORCE=2 as int) as INLABOR,
  cast(EDUC>=6 and EDUC<10 as int) as HSEDU, cast(EDUC>=10 as int) as COLEDU,
  cast(MULTGEN>2 as int) as TRIGEN, ln(HCOSTRATIO) as LOGRATIO from people where STATEFIP=8),
fitrows as (select * from rows where AGE>=20 and AGE<=199 and PERWT<>0)"""
_MEDIANS = ("med as (" + _median_sql("(select * from fitrows where YEAR=1995)", "AGEGROUP", "HCOSTRATIO", "PERWT")
            .replace(" as median", " as HCOSTRATIO") + ")")


def _newton(steps: int = 9) -> str:
    """Newton steps of the two-parameter model per year and age group, written out."""
    out = ["d as materialized (select YEAR, AGEGROUP, PERWT as w, HEADSHIP as y, LOGRATIO as x from fitrows "
           "where LOGRATIO is not null)",
           "n0 as materialized (select YEAR, AGEGROUP, 0.0e0 as a, 0.0e0 as b from d group by 1,2)"]
    for i in range(1, steps + 1):
        out.append(f"""n{i} as materialized (select YEAR, AGEGROUP, a+(h11*g0-h01*g1)/(h00*h11-h01*h01) as a,
          b+(h00*g1-h01*g0)/(h00*h11-h01*h01) as b from (
          select YEAR, AGEGROUP, a, b, sum(w*(y-p)) as g0, sum(w*(y-p)*x) as g1, sum(w*p*(1-p)) as h00,
            sum(w*p*(1-p)*x) as h01, sum(w*p*(1-p)*x*x) as h11 from (
            select d.*, a, b, 1/(1+exp(-(a+b*x))) as p from d join n{i - 1} n on d.YEAR=n.YEAR
              and d.AGEGROUP=n.AGEGROUP) group by 1,2,3,4))""")
    out.append(f"coef as (select * from n{steps})")
    return ",\n".join(out)


def newton(model: LogitSpec, steps: int = 15) -> str:
    """Newton steps of any model per year and age group, as a recursive table ``coef_<model>`` with coefficients
    ``b0 …`` and whether the last step still moved. Every step sums gradient (g) and curvature (h), and solves by
    elimination written out; a term whose pivot vanishes (o is the pivot before) gets no step."""
    size, name = len(model.terms) + 1, model.name
    x = ["1.0e0", *[f"x{j}" for j in range(1, size)]]
    listed = ", ".join(f"b{j}" for j in range(size))
    sums = [f"sum(r*{x[j]}) as g{j}" for j in range(size)]
    sums += [f"sum(c*{x[j]}*{x[k]}) as h{j}_{k}" for j in range(size) for k in range(j, size)]
    sums += [f"sum(c*{x[j]}*{x[j]}) as o{j}" for j in range(size)]
    eta = " + ".join(f"b{j}*{x[j]}" for j in range(size))
    body = f"""select i, YEAR, AGEGROUP, {listed}, {", ".join(sums)} from (
      select *, w*(y-p) as r, w*p*(1-p) as c from (select d.*, n.i, {listed}, 1/(1+exp(-({eta}))) as p
      from d_{name} d join n_{name} n on d.YEAR=n.YEAR and d.AGEGROUP=n.AGEGROUP where n.i<{steps})) group by all"""
    for k in range(size):
        body = f"select *, case when h{k}_{k}>1e-9*greatest(o{k}, 1e-300) then 1/h{k}_{k} else 0e0 end as v{k} from ({body})"
        changed = [f"g{j}-h{k}_{j}*v{k}*g{k} as g{j}" for j in range(k + 1, size)]
        changed += [f"h{j}_{m}-h{k}_{j}*v{k}*h{k}_{m} as h{j}_{m}" for j in range(k + 1, size) for m in range(j, size)]
        if changed:
            body = f"select * replace ({', '.join(changed)}) from ({body})"
    for k in reversed(range(size)):
        rest = "".join(f"-h{k}_{m}*s{m}" for m in range(k + 1, size))
        body = f"select *, (g{k}{rest})*v{k} as s{k} from ({body})"
    complete = " and ".join(["true", *[f"{t} is not null" for t in model.terms]])
    terms = "".join(f", cast({t} as double) as x{j}" for j, t in enumerate(model.terms, 1))
    moved = " + ".join(f"abs(s{j})" for j in range(size))
    return f"""d_{name} as materialized (select YEAR, AGEGROUP, PERWT as w, HEADSHIP as y{terms} from fitrows
      where HEADSHIP is not null and {complete}),
    n_{name} as (select 0 as i, YEAR, AGEGROUP, {", ".join(f"0e0 as b{j}" for j in range(size))}, 0e0 as moved
      from (select distinct YEAR, AGEGROUP from d_{name}) union all
      select i+1, YEAR, AGEGROUP, {", ".join(f"b{j}+s{j}" for j in range(size))}, {moved} from ({body})),
    coef_{name} as materialized (select * from n_{name} where i={steps})"""


def _rate(model: LogitSpec, cost: str) -> str:
    """Fitted probability with the cost term replaced."""
    terms = [cost if t == cf.COST else f"r.{t}" for t in model.terms]
    return f"1/(1+exp(-({' + '.join(['b0', *[f'b{j}*{t}' for j, t in enumerate(terms, 1)]])})))"


def _cfrows(model: LogitSpec) -> str:
    """Rows of the model ages with the counterfactual rate of a model."""
    return f"""cfrows as (select r.YEAR, r.AGEGROUP, r.PERWT, r.AGE, {_rate(model, "ln(med.HCOSTRATIO)")} as NEWHR
  from rows r left join med on r.AGEGROUP=med.AGEGROUP left join coef_{model.name} c on r.YEAR=c.YEAR
  and r.AGEGROUP=c.AGEGROUP where r.AGE>=20 and r.AGE<=199)"""


def rows(spark, sf_dir, years=None):
    """Staged model rows of the years."""
    return stage(cf.model_rows(prepared.analysis_people(spark, sf_dir), STATE, years))


def formula_rows(spark, sf_dir):
    """Rows of the fitted year and ages for formula models, without those of zero weight."""
    return stage(cf.model_rows(prepared.analysis_people(spark, sf_dir), STATE, [NOW], *AGES)
                 .filter(F.col("PERWT") != 0))


@query("D22_model_covariates", "YEAR:int AGE:int AGEGROUP:str PERWT:int NCHILD:int HEADSHIP:int MARRIED:int "
       "INLABOR:int HSEDU:int COLEDU:int TRIGEN:int LOGRATIO:d6", _USES,
       f"with {_ROWS}\nselect * from rows where YEAR in (1995, 1999) and AGE>=20 and AGE<=199")
def _(spark, sf_dir):
    return cf.model_rows(prepared.analysis_people(spark, sf_dir), STATE, (BASE_YEAR, NOW), *AGES)


@query("D23_baseline_cost_burden", "AGEGROUP:str HCOSTRATIO:d6", _USES, f"with {_ROWS},\n{_MEDIANS}\nselect * from med")
def _(spark, sf_dir):
    return cf.baseline_burden(rows(spark, sf_dir, (BASE_YEAR,)), BASE_YEAR, *AGES)


@query("J10_counterfactual_replacement", "YEAR:int AGE:int AGEGROUP:str PERWT:int HCOSTRATIO:d6", _USES,
       f"""with {_ROWS},\n{_MEDIANS}
       \nselect r.YEAR, r.AGE, r.AGEGROUP, r.PERWT, med.HCOSTRATIO from rows r left join med on r.AGEGROUP=med.AGEGROUP
       where r.YEAR=1999 and AGE>=20 and AGE<=199""")
def _(spark, sf_dir):
    """Current rows with the cost ratio replaced by the baseline year's median of their age group."""
    current = rows(spark, sf_dir, (BASE_YEAR, NOW)).filter(F.col("AGE").between(*AGES))
    return cf.counterfactual_input(current, cf.baseline_burden(current, BASE_YEAR, *AGES), (NOW,))


@query("M3_rates_of_the_age_model", "YEAR:int AGEGROUP:str rate:d6", _USES,
       f"""with {_ROWS}\nselect YEAR, AGEGROUP, cast(sum(HEADSHIP*PERWT) as double)/sum(PERWT) as rate
       from fitrows group by 1,2""")
def _(spark, sf_dir):
    """The model with age groups alone reproduces the weighted mean of every group."""
    coefs = cf.fit_models(rows(spark, sf_dir), *AGES, models=cf.MODELS[:1])
    return coefs.withColumn("rate", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(cf.MODELS[0].coef(0)))))


@query("M3_coefficients_of_the_base_model", "YEAR:int AGEGROUP:str intercept:d5 slope:d5", _USES,
       f"with {_ROWS},\n{_newton()}\nselect YEAR, AGEGROUP, a as intercept, b as slope from coef")
def _(spark, sf_dir):
    coefs = cf.fit_models(rows(spark, sf_dir), *AGES, models=(BASE,))
    return coefs.withColumnsRenamed({BASE.coef(0): "intercept", BASE.coef(1): "slope"})


@query("M3_score_of_the_full_model", "YEAR:int AGEGROUP:str term:str score:d1", _USES,
       f"""with {_ROWS}\nselect YEAR, AGEGROUP, term, 0.0e0 as score from fitrows,
       (select unnest(['intercept', {", ".join(f"'{t}'" for t in cf.FULL.terms)}]) as term) group by 1,2,3""")
def _(spark, sf_dir):
    """At the optimum the weighted residuals are orthogonal to every covariate, in every group."""
    staged = rows(spark, sf_dir).filter(F.col("AGE").between(*AGES) & (F.col("PERWT") != 0))
    joined = keyed_join(staged, cf.fit_models(staged, *AGES, models=(cf.FULL,)), cf.CELL)
    resid = F.col("PERWT") * (F.col("HEADSHIP") - predicted(cf.FULL))
    scores = joined.groupBy(*cf.CELL).agg(F.sum(resid).alias("intercept"), *[
        F.sum(resid * F.col(t)).alias(t) for t in cf.FULL.terms])
    return longer(scores, list(cf.CELL), ["intercept", *cf.FULL.terms], "term", "score")


def _long_sql(model: LogitSpec) -> str:
    return " union all ".join(f"select YEAR, AGEGROUP, '{model.coef(j)}' as term, case when moved<1e-6 then b{j} end as value "
                              f"from coef_{model.name}" for j in range(model.size))


@query("D24_five_models", "YEAR:int AGEGROUP:str term:str value:d4", _USES,
       f"with recursive {_ROWS},\n{', '.join(newton(m) for m in cf.MODELS)}\nselect * from (\n"
       + " union all ".join(_long_sql(m) for m in cf.MODELS) + ")")
def _(spark, sf_dir):
    """Coefficients of all five models for every year and age group; missing where outcomes are separated."""
    coefs = cf.fit_models(rows(spark, sf_dir), *AGES)
    settled = coefs.select(*cf.CELL, *[F.when(F.col(m.status) == "settled", F.col(m.coef(j))).alias(m.coef(j))
                                       for m in cf.MODELS for j in range(m.size)])
    return longer(settled, list(cf.CELL), [c for c in settled.columns if c not in cf.CELL], "term", "value")


@query("M4_age_formula_predictions", "AGEGROUP:str rate:d4", _USES,
       f"""with {_ROWS}\nselect AGEGROUP, cast(sum(HEADSHIP*PERWT) as double)/sum(PERWT) as rate from fitrows
       where YEAR=1999 group by 1""")
def _(spark, sf_dir):
    """Response-scale predictions of a formula fitted by Spark ML."""
    data = formula_rows(spark, sf_dir)
    formula = "HEADSHIP ~ AGEGROUP"
    told = predict_formula(fit_formula(data, formula, "PERWT"), data, formula, "NEWHR")
    return told.groupBy("AGEGROUP").agg(fn.weighted_mean(F.col("NEWHR"), F.col("PERWT")).alias("rate"))


@query("M4_formula_with_interactions", "AGEGROUP:str MARRIED:int rows:bigint told:bigint rate:d4", _USES,
       f"""with {_ROWS}\nselect AGEGROUP, MARRIED, count(*) as rows, count(MARRIED) as told,
       case when MARRIED is not null then cast(sum(HEADSHIP*PERWT) as double)/sum(PERWT) end as rate from fitrows
       where YEAR=1999 group by 1,2""")
def _(spark, sf_dir):
    """A formula with an interaction reproduces the weighted mean of every combination; rows that lack a covariate
    get no rate."""
    data = formula_rows(spark, sf_dir)
    formula = "HEADSHIP ~ AGEGROUP * MARRIED"
    told = predict_formula(fit_formula(data, formula, "PERWT"), data, formula, "NEWHR")
    return told.groupBy("AGEGROUP", "MARRIED").agg(F.count("*").alias("rows"), F.count("NEWHR").alias("told"), F.when(
        F.col("MARRIED").isNotNull(), fn.weighted_mean(F.col("NEWHR"), F.col("PERWT"))).alias("rate"))


_CF_BASE = f"""{_newton()},
cfrows as (select r.YEAR, r.AGEGROUP, r.PERWT, r.AGE, 1/(1+exp(-(a+b*ln(med.HCOSTRATIO)))) as NEWHR
  from rows r left join med on r.AGEGROUP=med.AGEGROUP left join coef on r.YEAR=coef.YEAR and r.AGEGROUP=coef.AGEGROUP
  where r.AGE>=20 and r.AGE<=199)"""


def _rates(staged, years, models):
    medians = cf.baseline_burden(staged, BASE_YEAR, *AGES)
    coefs = cf.fit_models(staged, *AGES, years, models)
    return cf.counterfactual_rates(cf.counterfactual_sums(staged, coefs, medians, years, *AGES, models), models)


@query("D8_observed_rates_by_year", "AGEGROUP:str 1995:d6 1999:d6", _USES,
       f"""with {_ROWS}\nselect AGEGROUP, """ + ", ".join(
           f'cast(sum(case when YEAR={y} then HEADSHIP*PERWT end) as double)/sum(case when YEAR={y} then PERWT end) '
           f'as "{y}"' for y in (BASE_YEAR, NOW)) + " from rows where AGE>=15 and YEAR in (1995, 1999) group by 1")
def _(spark, sf_dir):
    data = cf.model_rows(prepared.analysis_people(spark, sf_dir), STATE)
    return cf.observed_rates(data, (BASE_YEAR, NOW))


_ALL_RATES = ",\n".join(f"""cf_{m.name} as (with {_cfrows(m)} select AGEGROUP, sum(NEWHR*PERWT)/sum(PERWT) as {m.name}
  from cfrows where YEAR=1999 group by 1)""" for m in cf.MODELS)
_OBSERVED = "observed as (select AGEGROUP, " + ", ".join(
    f'cast(sum(case when YEAR={y} then HEADSHIP*PERWT end) as double)/sum(case when YEAR={y} then PERWT end) as "{y}"'
    for y in (BASE_YEAR, NOW)) + " from rows where AGE>=15 and YEAR in (1995, 1999) group by 1)"


@query("D25_counterfactual_rates", "AGEGROUP:str age:d4 base:d4 family:d4 income_education:d4 full:d4 1995:d6 1999:d6",
       _USES, f"with recursive {_ROWS},\n{_MEDIANS},\n{', '.join(newton(m) for m in cf.MODELS)},\n{_ALL_RATES},\n{_OBSERVED}"
       f"""\nselect * from cf_age {" ".join(f"left join cf_{m.name} using (AGEGROUP)" for m in cf.MODELS[1:])}
       left join observed using (AGEGROUP)""")
def _(spark, sf_dir):
    """Counterfactual headship by model beside the observed rates."""
    staged = rows(spark, sf_dir, (BASE_YEAR, NOW))
    return keyed_join(_rates(staged, (NOW,), cf.MODELS), cf.observed_rates(staged, (BASE_YEAR, NOW)), ["AGEGROUP"])


@query("D25_counterfactual_rates_base_model", "YEAR:int AGEGROUP:str base:d5", _USES,
       f"""with {_ROWS},\n{_MEDIANS},\n{_CF_BASE}
       \nselect YEAR, AGEGROUP, sum(NEWHR*PERWT)/sum(PERWT) as base from cfrows group by 1,2""")
def _(spark, sf_dir):
    return _rates(rows(spark, sf_dir), YEARS, (BASE,))


_BY_AGE = f"""young as (select YEAR, AGEGROUP, sum(PERWT*0.04e0) as NEWHH from rows
  where PERWT<>0 and AGE<20 and AGE>=15 group by 1,2),
actual as (select YEAR, AGEGROUP, sum(PERWT*HEADSHIP) as HH from rows where PERWT<>0 and AGE>=15 and AGE<=199 group by 1,2),
byage as (select a.YEAR, a.AGEGROUP, HH, NEWHH, NEWHH-HH as MISSINGHH from actual a left join
  (select * from young union all select YEAR, AGEGROUP, {strict('NEWHR*PERWT')} from cfrows group by 1,2) t
  on a.YEAR=t.YEAR and a.AGEGROUP=t.AGEGROUP)"""


def _decompose(spark, sf_dir, years, model):
    stats = cf.unit_scalars(prepared.units(spark, sf_dir, "duration"), STATE)
    return cf.decompose(prepared.analysis_people(spark, sf_dir), stats, years, BASE_YEAR, STATE, *AGES,
                        VACANCY_RATE, model)


_BY_AGE_COLS = "baseline_year:int analysis_year:int AGEGROUP:str HH:bigint NEWHH:d{0} MISSINGHH:d{0}"


_FULL = f"{newton(cf.FULL)},\n{_cfrows(cf.FULL)}"


@query("D26_target_households_by_age", _BY_AGE_COLS.format(1), _USES,
       f"""with recursive {_ROWS},\n{_MEDIANS},\n{_FULL},\n{_BY_AGE}
       \nselect 1995 as baseline_year, YEAR as analysis_year, AGEGROUP, HH, NEWHH, MISSINGHH from byage where YEAR=1999""")
def _(spark, sf_dir):
    return _decompose(spark, sf_dir, (NOW,), cf.FULL)[1]


@query("D26_target_households_by_age_base_model", _BY_AGE_COLS.format(3), _USES,
       f"""with {_ROWS},\n{_MEDIANS},\n{_CF_BASE},\n{_BY_AGE}
       \nselect 1995 as baseline_year, YEAR as analysis_year, AGEGROUP, HH, NEWHH, MISSINGHH from byage where YEAR=1999""")
def _(spark, sf_dir):
    return _decompose(spark, sf_dir, (NOW,), BASE)[1]


_SUMMARY = f"""st as (select YEAR, sum(case when STATEFIP=8 and VACANCY=0 then HHWT end) as households,
  sum(HHWT) as housing_units, sum(case when SEASONAL then HHWT end) as seasonal_housing,
  coalesce(sum(case when (KITCHEN=1 or PLUMBING=10) and VACDUR>=7 then HHWT end),0) as uninhabitable_housing
  from units group by 1),
sm as (select YEAR, {strict('NEWHH')} as target_hh, sum(HH) as current_hh, {strict('MISSINGHH')} as missing_hh
  from byage group by 1),
summary as (select 1995 as baseline_year, sm.YEAR as analysis_year, target_hh, current_hh, missing_hh, households,
  0.05e0 as vacancy_rate, housing_units, seasonal_housing, uninhabitable_housing,
  (missing_hh+households)/0.95e0-(housing_units-seasonal_housing-uninhabitable_housing) as underproduction
  from sm left join st on sm.YEAR=st.YEAR)"""
_SUMMARY_COLS = ("baseline_year:int analysis_year:int target_hh:d{0} current_hh:bigint missing_hh:d{0} "
                 "households:bigint vacancy_rate:d2 housing_units:bigint seasonal_housing:bigint "
                 "uninhabitable_housing:bigint underproduction:d{0}")
_VARIABLES = ("target_hh current_hh missing_hh households vacancy_rate housing_units seasonal_housing "
              "uninhabitable_housing underproduction").split()


@query("D27_decomposition_of_one_year", _SUMMARY_COLS.format(1), _USES,
       f"""with recursive {_ROWS},\n{_MEDIANS},\n{_FULL},\n{_BY_AGE},\n{_SUMMARY}
       \nselect * from summary where analysis_year=1999""")
def _(spark, sf_dir):
    return _decompose(spark, sf_dir, (NOW,), cf.FULL)[0]


@query("D27_decomposition_of_one_year_base_model", _SUMMARY_COLS.format(3), _USES,
       f"""with {_ROWS},\n{_MEDIANS},\n{_CF_BASE},\n{_BY_AGE},\n{_SUMMARY}
       \nselect * from summary where analysis_year=1999""")
def _(spark, sf_dir):
    return _decompose(spark, sf_dir, (NOW,), BASE)[0]


_LONG_SUMMARY = " union all ".join(f"select baseline_year, analysis_year, '{v}' as variable, cast({v} as double) as value "
                                   "from summary" for v in _VARIABLES)


@query("D28_decomposition_of_all_years", "baseline_year:int analysis_year:int variable:str value:d1", _USES,
       f"with recursive {_ROWS},\n{_MEDIANS},\n{_FULL},\n{_BY_AGE},\n{_SUMMARY}\nselect * from ({_LONG_SUMMARY})")
def _(spark, sf_dir):
    return cf.long_summary(_decompose(spark, sf_dir, YEARS, cf.FULL)[0])


@query("D28_decomposition_of_all_years_base_model", "baseline_year:int analysis_year:int variable:str value:d3", _USES,
       f"""with {_ROWS},\n{_MEDIANS},\n{_CF_BASE},\n{_BY_AGE},\n{_SUMMARY}\nselect * from ({_LONG_SUMMARY})""")
def _(spark, sf_dir):
    return cf.long_summary(_decompose(spark, sf_dir, YEARS, BASE)[0])


def _scenarios(spark, sf_dir, model):
    staged = rows(spark, sf_dir, (NOW,))
    coefs = cf.fit_models(staged, *AGES, (NOW,), (model,))
    return cf.fixed_ratio_scenarios(staged, coefs, (NOW,), (1.0, 0.1), *AGES, model)


@query("D29_fixed_ratio_scenarios", "YEAR:int ratio:d2 missing_hh:d1", _USES,
       f"""with recursive {_ROWS},\n{newton(cf.FULL)},
       s as (select 1.0e0 as ratio union all select 0.1e0),
       t as (select r.YEAR, r.AGEGROUP, ratio, sum(PERWT*{_rate(cf.FULL, "ln(ratio)")}) as NEWHH
         from (select * from rows where YEAR=1999 and AGE>=20 and AGE<=199) r, s, coef_full c
         where r.YEAR=c.YEAR and r.AGEGROUP=c.AGEGROUP group by 1,2,3),
       actual as (select YEAR, AGEGROUP, sum(PERWT*HEADSHIP) as HH from rows where PERWT<>0 and AGE>=15 group by 1,2)
       \nselect t.YEAR, ratio, sum(NEWHH-HH) as missing_hh from t join actual a on t.YEAR=a.YEAR
       and t.AGEGROUP=a.AGEGROUP group by 1,2""")
def _(spark, sf_dir):
    return _scenarios(spark, sf_dir, cf.FULL)


@query("D29_fixed_ratio_scenarios_base_model", "YEAR:int ratio:d2 missing_hh:d3", _USES,
       f"""with {_ROWS},\n{_newton()},
       s as (select 1.0e0 as ratio union all select 0.1e0),
       t as (select r.YEAR, r.AGEGROUP, ratio, sum(PERWT/(1+exp(-(a+b*ln(ratio))))) as NEWHH
         from (select * from rows where YEAR=1999 and AGE>=20 and AGE<=199) r, s, coef
         where r.YEAR=coef.YEAR and r.AGEGROUP=coef.AGEGROUP group by 1,2,3),
       actual as (select YEAR, AGEGROUP, sum(PERWT*HEADSHIP) as HH from rows where PERWT<>0 and AGE>=15 group by 1,2)
       \nselect t.YEAR, ratio, sum(NEWHH-HH) as missing_hh from t join actual a on t.YEAR=a.YEAR
       and t.AGEGROUP=a.AGEGROUP group by 1,2""")
def _(spark, sf_dir):
    return _scenarios(spark, sf_dir, BASE)
