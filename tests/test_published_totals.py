"""Published totals recomputed from the published inputs of the same rows."""

import pytest

from tallyframe.plans import housing, prices, projections
from tests.conftest import rows

# Year, area, households, target, missing, seasonal, unfit, vacant, all units, then the
# published vacancy rate, necessary units, available units and underproduction.
AREAS = [
    (2001, None, 1759996, None, None, 34417, 3666, 67837, 1874400,
     0.03619131455399061, None, 1836317, None),
    (2023, "Colorado Springs, CO", 311544, 316998.62188284803, 5454.621882848029, 4251, 587, 7987, 327258,
     0.024405820484144008, 333682.75987668213, 322420, 11262.759876682132),
    (2023, "Denver-Aurora-Lakewood, CO", 1257157, 1309060.6123177256, 51903.6123177256, 10551, 2366, 34764, 1322418,
     0.026288208418215723, 1377958.5392818165, 1309501, 68457.53928181645),
    (2023, "Fort Collins, CO", 156514, 161312.35906023267, 4798.359060232673, 4996, 347, 4343, 167381,
     0.0259467920492768, 169802.48322129756, 162038, 7764.48322129756),
    (2023, "Grand Junction, CO", 62219, 63839.294843653304, 1620.2948436533034, 906, 352, 412, 64516,
     0.006386012772025544, 67199.25773016138, 63258, 3941.2577301613783),
    (2023, "Greeley, CO", 129043, 136446.340345903, 7403.340345903015, 329, 97, 3693, 134498,
     0.027457657362934765, 143627.7266798979, 134072, 9555.726679897896),
    (2023, "Not in identifiable area", 448425, 458047.7716214668, 9622.771621466767, 72722, 3508, 15737, 553584,
     0.028427483453278998, 482155.5490752282, 477354, 4801.54907522822),
    (2023, "Pueblo, CO", 63359, 64385.302207795845, 1026.302207795848, 1067, 222, 1843, 68438,
     0.026929483620210994, 67774.00232399564, 67149, 625.0023239956354),
]
# The state rows as published: sums that skip missing values, also of the rates.
STATE = [
    (2001, "Colorado Statewide", 1759996, 0, 0, 34417, 3666, 67837, 1874400, 0.03619131455399061, 0, 1836317, 0),
    (2023, "Colorado Statewide", 2428261, 2510090.302279625, 81829.30227962523, 94822, 7479, 68779, 2638093,
     0.16584145816008683, 2642200.3181890794, 2535792, 106408.31818907928),
]
# Monthly price index of four years (the last one has three months).
INDEX = {
    2000: (169.300, 170.000, 171.000, 170.900, 171.200, 172.200, 172.700, 172.700, 173.600, 173.900,
           174.200, 174.600),
    2023: (300.456, 301.476, 301.643, 302.858, 303.316, 304.099, 304.615, 306.138, 307.374, 307.653,
           308.087, 308.735),
    2024: (309.794, 311.022, 312.107, 313.016, 313.140, 313.131, 313.566, 314.131, 314.851, 315.564,
           316.449, 317.603),
    2025: (319.086, 319.775, 319.615),
}
# Year, band, survey persons and error, survey heads and error, projected heads and persons,
# and both published rates.
BANDS = [
    (2010, 1, 443079, 8810.535475703984, 107660, 4399.1651814003535, 112367, 489551,
     0.24298149991310805, 0.22953073326374576),
    (2010, 4, 533734, 7491.653792736329, 348200, 5952.772672012783, 356158, 554801,
     0.652384895846995, 0.6419563050535237),
    (2023, 2, 1771893, 18285.232928359015, 920070, 13563.051216396403, 827670, 1731833,
     0.5192582170593822, 0.47791559578781556),
    (2023, 3, 1372916, 14439.312454811357, 796630, 11098.975699024742, 797052, 1395860,
     0.5802467157495433, 0.5710114194833292),
]


@pytest.fixture(scope="module")
def metro(spark):
    cells = spark.createDataFrame([r[:5] for r in AREAS],
                                  "YEAR int, msa string, HH long, NEWHH double, MISSINGHH double")
    counts = spark.createDataFrame([(r[0], r[1], *r[5:9]) for r in AREAS],
                                   "YEAR int, msa string, housing_units_seasonal long, "
                                   "housing_units_uninhabitable long, housing_units_vacant long, "
                                   "housing_units long")
    return housing.metro_totals(cells, counts, 0.05)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert len(g) == len(w)
        for a, b in zip(g, w):
            assert a == (pytest.approx(b, rel=1e-12, abs=1e-6) if isinstance(b, float) else b), w[:2]


def test_area_rows(metro):
    same(rows(metro), rows_of(AREAS))


def rows_of(data):
    return sorted(data, key=lambda r: (r[0], r[1] is None, r[1] or ""))


def test_state_rows_as_published(metro):
    same(rows(housing.state_totals(metro, STATE[0][1], mode="reference")), STATE)


def test_state_rows_recomputed(metro):
    early, late = rows(housing.state_totals(metro, STATE[0][1]))
    assert early[3:5] == (None, None) and early[12] is None
    assert late[9] == pytest.approx(68779 / 2638093)
    assert late[12] == pytest.approx(STATE[1][12])


def test_area_and_state_rows_together(metro):
    assert housing.all_totals(metro, label=STATE[0][1], mode="reference").count() == len(AREAS) + 2


def test_unknown_modes_are_refused(metro):
    for call in (lambda: housing.state_totals(metro, mode="x"), lambda: housing.uninhabitable("x")):
        with pytest.raises(ValueError):
            call()


def test_missing_unfit_units_count_as_none(spark):
    df = spark.createDataFrame([(10, 0.0, 1, None, 2, 20), (10, 0.0, None, 1, 2, 20)],
                               "HH long, MISSINGHH double, housing_units_seasonal long, "
                               "housing_units_uninhabitable long, housing_units_vacant long, housing_units long")
    got = [r.available_units for r in housing.shortfall_columns(df, 0.05).collect()]
    assert got == [19, None]


def test_deflator(spark):
    index = spark.createDataFrame([(f"{y}-{m:02d}-01", v) for y, vs in INDEX.items()
                                   for m, v in enumerate(vs, start=1)], "d string, CPIAUCSL double")
    got = {r.YEAR: r for r in prices.deflator(
        index.selectExpr("cast(d as date) as observation_date", "CPIAUCSL"), 2023).collect()}
    assert got[2023].cpi == pytest.approx(304.704167, abs=1e-6)
    assert [round(got[y].adj_factor, 6) for y in (2000, 2023, 2024, 2025)] == [1.769564, 1.0, 0.971330, 0.953715]


def test_comparison_with_projections(spark):
    from pyspark.sql import functions as F

    from tallyframe.functions import ratio
    survey = spark.createDataFrame([r[:6] for r in BANDS], "year int, age_group_id int, pop long, pop_se double, "
                                   "hh long, hh_se double").withColumn("headship_rate", ratio(F.col("hh"), F.col("pop")))
    projected = spark.createDataFrame([(0, r[0], r[1], "band", r[6], r[7]) for r in BANDS] + [(0, 2050, 1, "band", 1, 2)],
                                      "area_code int, year int, age_group_id int, age_group string, hh long, pop long"
                                      ).withColumn("headship_rate", ratio(F.col("hh"), F.col("pop")))
    got = {(r.year, r.age_group_id): r for r in projections.comparison(survey, projected).collect()}
    assert len(got) == 5 and got[2050, 1].pop_survey is None and got[2050, 1].check_pop is None
    for b in BANDS:
        r = got[b[:2]]
        assert (r.headship_rate_survey, r.headship_rate_projected) == b[8:]
        assert r.check_pop == (abs(b[2] - b[7]) <= b[3])
