"""The shape of physical plans: what is read, moved and broadcast."""

import os
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import DataFrame, functions as F

from tallyframe.operators import joins, keyed_join, survey_counts
from tallyframe.operators.design import BLOCK
from tallyframe.plans import headship, housing, people
from tallyframe.session import drop_unused, release_staged, shared_folder, stage, staging
from tallyframe.sources import land_bucketed
from tallyframe.workload import catalog, views

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(autouse=True)
def nothing_unused(spark):
    """What earlier tests staged and no frame reads any more is gone before folders are compared."""
    drop_unused(collect=True)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    views.households(spark, SF_DIR).write.parquet(str(folder / "h"))
    views.persons(spark, SF_DIR).write.parquet(str(folder / "p"))
    return spark.read.parquet(str(folder / "h")), spark.read.parquet(str(folder / "p"))


@contextmanager
def without_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def read_columns(text):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


def test_missing_households_read_no_replicate_weights(spark, landed):
    h, p = landed
    joined = people.with_headship(people.household_members(housing.housing_units(h), p), 18, 45)
    text = plan(headship.state_cells(joined, 8, 1995))
    for cols in read_columns(text):
        assert not any(c.startswith("REPWT") for c in cols)
    # the household condition reaches the scan, and the outer join has become an inner one
    assert "RightOuter" not in text and "Inner" in text
    assert re.search(r"PushedFilters: \[[^\]]*STATEFIP", text)
    # one scan of each table: baseline rates come from the cells
    assert text.count("FileScan") == 2


def test_five_counts_read_the_households_once(spark, landed):
    units = housing.housing_units(landed[0])
    labels = views.area_labels(spark, SF_DIR)
    text = plan(housing.unit_counts(units, labels, 8))
    assert sum("REPWT1" in c for c in read_columns(text)) == 1
    assert all("OWNCOST" not in c for c in read_columns(text))


@pytest.mark.parametrize("name", ["A3_survey_mean_se", "D8_headship_table"])
def test_means_join_few_weights_at_a_time(spark, name):
    text = plan(catalog.queries()[name](spark, SF_DIR))
    carried = [set(re.findall(r"\bREPWTP\d+#", line)) for line in text.splitlines()]
    assert 0 < max(map(len, carried)) <= BLOCK


@pytest.mark.parametrize("name", ["A3_survey_mean_se", "D8_headship_table"])
def test_large_joins_have_more_partitions_the_more_they_read(spark, monkeypatch, name):
    read = sum(os.path.getsize(f"{SF_DIR}/{t}.parquet") for t in ("orders", "customer", "lineitem", "orders"))
    found = []
    with without_broadcasts(spark):
        for parts in (40, 80):
            monkeypatch.setattr(joins, "PART_BYTES", -(-read // parts))
            text = plan(catalog.queries()[name](spark, SF_DIR))
            found.append({int(n) for n in re.findall(r"hashpartitioning\(__right_YEAR[^)]*\)[^)]*\)[^)]*, (\d+)\), REPARTITION_BY_NUM", text)})
            # neither side is moved again for the join
            assert not re.search(r"hashpartitioning\([^\n]*SERIAL[^\n]*ENSURE_REQUIREMENTS", text)
    assert all(len(n) == 1 for n in found) and abs(min(found[0]) - 40) <= 1 and abs(min(found[1]) - 80) <= 1


def test_dealt_members_are_the_same(spark, tmp_path, monkeypatch):
    """Missing and repeated keys, with as many partitions as the files ask for."""
    key = ["cast(1995 + id % 2 as int) as YEAR", "nullif(id % 50, 7) as SERIAL", "if(id % 3 = 0, null, id % 50) as CBSERIAL", "1 as SAMPLE"]
    spark.range(150).selectExpr(*key, "cast(id % 6 as int) as GQ").write.parquet(str(tmp_path / "h"))
    spark.range(400).selectExpr(*key, "id as n").write.parquet(str(tmp_path / "p"))
    h, p = spark.read.parquet(str(tmp_path / "h")), spark.read.parquet(str(tmp_path / "p"))

    def rows():
        members = people.household_members(h, p)
        return "REPARTITION_BY_NUM" in plan(members), sorted(map(str, members.collect()))

    with without_broadcasts(spark):
        few, before = rows()
        monkeypatch.setattr(joins, "PART_BYTES", 500)
        many, after = rows()
    assert not few and many and before and before == after


def test_a_task_joins_as_many_members_of_larger_tables(spark, tmp_path, monkeypatch):
    """Four times the households and members, and no task of the join holds more rows."""
    monkeypatch.setattr(joins, "PART_BYTES", 4000)
    most = []
    for n in (4000, 16000):
        key = ["cast(1995 + id % 7 as int) as YEAR", "id as SERIAL", "id * 10 as CBSERIAL", "1 as SAMPLE"]
        folder = str(tmp_path / str(n))
        spark.range(n).selectExpr(*key, "1 as GQ").write.parquet(f"{folder}/h")
        spark.range(n * 3).selectExpr(f"id % {n} as id", "id as n").selectExpr(*key, "n").write.parquet(f"{folder}/p")
        members = people.household_members(spark.read.parquet(f"{folder}/h"), spark.read.parquet(f"{folder}/p"))
        with without_broadcasts(spark):
            held = [r["count"] for r in members.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(held) == n * 3
        most.append(max(held))
    assert most[1] < 1.5 * most[0]


def test_bucketed_tables_are_not_dealt(spark, landed, tmp_path, monkeypatch):
    land_bucketed(landed[0], "d_households", str(tmp_path / "h"), 4)
    try:
        monkeypatch.setattr(joins, "PART_BYTES", 1)
        joined = people.household_members(spark.table("d_households"), landed[1])
        assert "REPARTITION_BY_NUM" not in plan(joined)
    finally:
        spark.sql("drop table if exists d_households")


def test_database_tables_are_not_dealt(spark, landed):
    """They tell no size. The tables are only planned with; nothing connects to a database."""
    jvm = spark._jvm
    jdbc = jvm.org.apache.spark.sql.execution.datasources.jdbc
    options = jdbc.JDBCOptions(jvm.PythonUtils.toScalaMap({"url": "jdbc:none:", "dbtable": "t", "driver": "java.lang.Object"}))

    def table(like):
        schema = spark._jsparkSession.parseDataType(like.schema.json())
        parts = spark.sparkContext._gateway.new_array(jvm.org.apache.spark.Partition, 0)
        relation = jdbc.JDBCRelation(schema, parts, options, jvm.PythonUtils.toScalaMap({}), spark._jsparkSession)
        return DataFrame(spark._jsparkSession.baseRelationToDataFrame(relation), spark)

    h, p = landed
    for units, persons in ((table(h), p), (h, table(p)), (table(h), table(p))):
        joined = people.household_members(units, persons)
        assert joined.columns == people.household_members(h, p).columns
        assert "RepartitionByExpression" not in joined._jdf.queryExecution().analyzed().toString()


def test_domains_are_one_scan(spark, landed):
    design = housing.household_design(landed[0])
    text = plan(survey_counts(design, ["YEAR"], {"a": F.col("VACANCY") == 0, "b": F.col("VACANCY") == 1}))
    assert text.count("FileScan") == 1


def test_missing_safe_join_is_still_a_hash_or_merge_join(spark):
    a = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"))
    b = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").alias("b"))
    text = plan(keyed_join(a, b, ["k"]))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_state_rows_come_from_the_area_rows(spark):
    text = plan(catalog.queries()["D12_all_totals_recomputed"](spark, SF_DIR))
    files = re.findall(r"FileScan parquet[^\n]*", text)
    assert len(files) == 2 and all("/staged-" in f for f in files)


def test_report_is_sorted(spark):
    found = [(r.msa == "Statewide", r.YEAR, r.msa is None, r.msa or "")
             for r in catalog.queries()["D12_all_totals_recomputed"](spark, SF_DIR).collect()]
    assert found == sorted(found) and found[-1][0]


def test_names_meet_sums_only(spark):
    """The label join stands above the first aggregation, so records with 81 weights are not shuffled for it."""
    text = plan(catalog.queries()["A2_survey_count_se"](spark, SF_DIR)).split("\n")
    last_join = max(i for i, line in enumerate(text) if "Join" in line and "MET2013" in line)
    assert any("HashAggregate" in line for line in text[last_join:])


def test_bands_are_summed_before_the_all_ages_row(spark):
    text = plan(catalog.queries()["D18_projected_headship"](spark, SF_DIR))
    generate = text.index("Generate explode")
    assert "sum(totalpopulation" in text[generate:]


def test_filters_of_a_table_read_are_pushed(spark):
    text = plan(catalog.queries()["S6_table_scan_pushed"](spark, SF_DIR))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(area_code,0\)[^\]]*EqualTo\(household_type_id,0\)", text)


@pytest.mark.parametrize("name", ["D10_metro_totals", "A2_survey_count_se", "D19_survey_against_projection", "J6_chained_natural_joins"])
def test_no_round_robin_exchange(spark, name):
    assert "RoundRobin" not in plan(catalog.queries()[name](spark, SF_DIR))


@pytest.mark.parametrize("name", ["D10_metro_totals", "D12_all_totals_recomputed", "D14_long_run_vacancy_shortfall",
                                  "D16_sweep_of_end_years", "D17_total_rate_and_average",
                                  "D19_survey_against_projection", "D20_housing_type_shares",
                                  "D32_yearly_statistics", "J12_years_with_one_row_aggregate"])
def test_no_cross_join_and_no_python_in_the_plan(spark, name):
    text = plan(catalog.queries()[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython",
                 "MapInPandas", "FlatMapGroups"):
        assert word not in text


def test_bucketed_tables_join_without_a_shuffle(spark, landed, tmp_path):
    land_bucketed(landed[0], "b_households", str(tmp_path / "h"), 4)
    land_bucketed(landed[1], "b_persons", str(tmp_path / "p"), 4)
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false",
                "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = people.household_members(spark.table("b_households"), spark.table("b_persons"))
        assert "Exchange" not in plan(joined)
        plain = people.household_members(*landed)
        assert "Exchange" in plan(plain) and joined.count() == plain.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql("drop table if exists b_households")
        spark.sql("drop table if exists b_persons")


def folders(spark):
    where = shared_folder(spark).removeprefix("file:")
    return set(os.listdir(where)) if os.path.isdir(where) else set()


def test_staged_tables_go_to_the_shared_folder(spark):
    before = folders(spark)
    staged = stage(spark.range(10).withColumn("v", F.col("id") * 2))
    assert f"{shared_folder(spark)}/staged-" in plan(staged) and staged.count() == 10
    assert len(folders(spark) - before) == 1
    release_staged(staged)
    assert folders(spark) == before


@pytest.mark.parametrize("name", ["A8_weighted_median", "D27_decomposition_of_one_year_base_model", "S8_landed_copy_by_year"])
def test_nothing_staged_is_left_behind(spark, name):
    before = folders(spark)
    with staging():
        assert catalog.queries()[name](spark, SF_DIR).collect()
        assert folders(spark) - before
    assert folders(spark) == before


def test_no_shared_folder_is_an_error(spark, monkeypatch):
    class Nothing:
        conf = {}
        sparkContext = type("C", (), {"getCheckpointDir": staticmethod(lambda: None)})

    Nothing.conf = type("C", (), {"get": staticmethod(lambda *a: None)})
    with pytest.raises(ValueError):
        shared_folder(Nothing)


def test_cells_equal_the_sum_over_persons(spark, landed):
    joined = people.with_headship(people.household_members(housing.housing_units(landed[0]), landed[1]), 18, 45)
    labels = views.area_labels(spark, SF_DIR)
    cells = headship.metro_cells(joined, labels, 8, 1995)
    direct = joined.filter("STATEFIP = 8").agg(F.sum(F.col("HEADSHIP").cast("int") * F.col("PERWT"))).collect()[0][0]
    assert cells.agg(F.sum("HH")).collect()[0][0] == direct
    assert cells.filter("MISSINGHH < 0").count() == 0
    assert cells.filter("YEAR = 1995 and NEWHR is null").count() == 0
