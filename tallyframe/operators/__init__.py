from tallyframe.operators.design import SurveyDesign, survey_count, survey_counts, survey_mean
from tallyframe.operators.joins import full_join, keyed_join, natural_join
from tallyframe.operators.logit import LogitSpec, fit_formula, fit_logit_by, predicted
from tallyframe.operators.median import weighted_median
from tallyframe.operators.reshape import (
    across, longer, matching, relocate, union_fill, wider, without,
)
from tallyframe.operators.totals import append_totals, group_share, with_missing_years

__all__ = [
    "LogitSpec", "SurveyDesign", "across", "append_totals", "fit_formula", "fit_logit_by",
    "full_join", "group_share", "keyed_join", "longer", "matching", "natural_join",
    "predicted", "relocate", "survey_count", "survey_counts", "survey_mean", "union_fill",
    "weighted_median", "wider", "with_missing_years", "without",
]
