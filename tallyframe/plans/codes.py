"""The microdata coding these analyses rely on."""

from __future__ import annotations

# Record keys.
HOUSEHOLD_KEY = ("YEAR", "SERIAL", "CBSERIAL", "SAMPLE")
# CBSERIAL is absent from the earlier samples, where missing has to match missing.
NULLABLE_KEY = ("CBSERIAL",)

# Group-quarters codes.
GQ_INSTITUTIONS = (3, 4)
GQ_HOUSEHOLDS = (0, 1, 2, 5)
GQ_OCCUPIED = (1, 2, 5)

# Vacancy codes.
VACANCY_OCCUPIED = 0
VACANCY_RENT = 1
VACANCY_SALE = 2
VACANCY_TAKEN = 3
VACANCY_SEASONAL = 4
VACANCY_AVAILABLE = (1, 2, 3)
VACANCY_NOT_ON_MARKET = (4, 5, 6, 7, 9)

# Facilities, duration, tenure and relationship codes.
KITCHEN_NONE = 1
PLUMBING_NONE = 10
LONG_VACANT = 7
OWNED = 1
RENTED = 2
HEAD = 1

# Sentinels for "not applicable".
INCOME_MISSING = 9999999
OWNCOST_MISSING = 99999

# Covariate codes.
MARRIED = (1, 2)
IN_LABOR_FORCE = 2
EDUC_HIGH_SCHOOL = 6
EDUC_COLLEGE = 10
MULTGEN_TWO = 2

# Half-width of a 90 % interval, uplift and headship rate of the youngest.
MOE_FACTOR = 1.645
VACANCY_UPLIFT = 1.05
YOUNG_HEADSHIP = 0.04

# Age bands of the external projections and cost-burden classes.
PROJECTION_BANDS = (18, 24, 44, 64, float("inf"))
BURDEN_BREAKS = (0, 0.35, 0.60, float("inf"))
BURDEN_LABELS = ("0-35%", "35-60%", ">60%")
