import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import incremental as inc
from tablecraft.operators.evolve import Consumers, columns_from_fields, evolve, evolve_frame
from tablecraft.operators.layout import Layout, scan, time_partition
from tablecraft.plans import schema as sc
from tablecraft.plans.contract import ContractError, check_contract, contract_findings, drift_findings, file_drift
from tablecraft.plans.schema import Field, SchemaError
from tests.conftest import as_rows


@pytest.fixture
def people(spark, warehouse):
    warehouse.create("t", spark.createDataFrame([(1, "ann", "x"), (2, "bob", "y")], "id bigint, name string, old_col string"))
    return warehouse


ID, NAME, OLD = Field("id", "INT64"), Field("name", "STRING"), Field("old_col", "STRING")


def test_no_data_is_rewritten(people):
    before = people.manifest("t").segments
    evolve(people, "t", [ID, Field("full_name", "STRING", alter="rename", alter_from="name"),
                         Field("old_col", "STRING", alter="delete"), Field("age", "INT64", alter="insert", default="40 + 2")])
    assert people.manifest("t").segments == before
    assert people.read("t").columns == ["id", "full_name", "age"]
    assert as_rows(people.read("t")) == [(1, "ann", 42), (2, "bob", 42)]


def test_later_rows_use_new_names_and_defaults(spark, people):
    evolve(people, "t", [ID, NAME, OLD, Field("tag", "STRING", alter="insert", default="'none'")])
    inc.append(people, "t", spark.createDataFrame([(3, "cy", "z")], "id bigint, name string, old_col string"))
    inc.append(people, "t", spark.createDataFrame([(4, "di", "z", None)], "id bigint, name string, old_col string, tag string"))
    assert as_rows(people.read("t"), "id", "tag") == [(1, "none"), (2, "none"), (3, "none"), (4, None)]
    assert people.read("t").where("tag = 'none'").count() == 3


def test_a_name_that_comes_back_is_a_new_column(spark, people):
    evolve(people, "t", [ID, NAME, Field("old_col", "STRING", alter="delete")])
    evolve(people, "t", [ID, NAME, Field("old_col", "INT64", alter="insert")])
    assert as_rows(people.read("t"), "id", "old_col") == [(1, None), (2, None)]
    inc.merge(people, "t", spark.createDataFrame([(1, "ann", 5)], "id bigint, name string, old_col bigint"), "id")
    assert as_rows(people.read("t"), "id", "old_col") == [(1, 5), (2, None)]


def test_swap_applied_twice_is_applied_once(people):
    swap = [ID, Field("name", "STRING", alter="rename", alter_from="old_col"),
            Field("old_col", "STRING", alter="rename", alter_from="name")]
    evolve(people, "t", swap)
    swapped = as_rows(people.read("t"), "id", "name", "old_col")
    assert swapped == [(1, "x", "ann"), (2, "y", "bob")]
    evolve(people, "t", swap)
    assert as_rows(people.read("t"), "id", "name", "old_col") == swapped


def test_every_action_is_idempotent(people):
    fields = [ID, Field("label", "STRING", alter="rename", alter_from="name"),
              Field("old_col", "STRING", alter="delete"), Field("n", "INT64", alter="insert")]
    evolve(people, "t", fields)
    version = people.manifest("t").version
    evolve(people, "t", fields)
    assert people.manifest("t").version == version
    with_note = [*fields, Field("m", "INT64", alter="insert")]
    evolve(people, "t", with_note)
    assert people.read("t").columns == ["id", "label", "n", "m"]


def test_descriptions(people):
    evolve(people, "t", [Field("id", "INT64", description="the key"), NAME, OLD])
    assert people.read("t").schema["id"].metadata["comment"] == "the key"
    evolve(people, "t", [ID, NAME, OLD])
    assert "comment" not in people.read("t").schema["id"].metadata


@pytest.mark.parametrize(
    "consumers",
    [Consumers(unique_keys=["OLD_COL"]), Consumers(partition_fields=["old_col"]), Consumers(cluster_columns=["Old_Col"])],
)
def test_needed_columns_are_not_dropped(people, consumers):
    drop = [ID, Field("n", "INT64", alter="insert"), NAME, Field("old_col", "STRING", alter="delete")]
    with pytest.raises(SchemaError, match="column 'old_col' has to stay"):
        evolve(people, "t", drop, consumers)
    assert people.read("t").columns == ["id", "name", "old_col"]


def test_layout_follows_a_rename(spark, warehouse):
    df = spark.sql("SELECT id, timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id AS INT)) AS ts FROM range(5)")
    warehouse.create("t", df, Layout(rules=(time_partition("ts"),), cluster_by=("id",)))
    evolve(warehouse, "t", [Field("key", "INT64", alter="rename", alter_from="id"),
                            Field("seen", "DATETIME", alter="rename", alter_from="ts")])
    assert scan(warehouse, "t", [("seen", ">=", dt.datetime(2024, 1, 4))]).count() == 2
    inc.append(warehouse, "t", spark.sql("SELECT 9L AS key, timestamp_ntz'2024-01-04 01:00:00' AS seen"))
    assert scan(warehouse, "t", [("seen", ">=", dt.datetime(2024, 1, 4))]).count() == 3
    with pytest.raises(SchemaError, match="column 'seen' has to stay"):
        evolve(warehouse, "t", [Field("key", "INT64"), Field("seen", "DATETIME", alter="delete")])


def test_frame_form_agrees(spark, people):
    fields = [ID, Field("label", "STRING", alter="rename", alter_from="name"),
              Field("old_col", "STRING", alter="delete"), Field("d", "DATE", alter="insert", default="DATE'2024-02-03'")]
    before = people.read("t")
    evolve(people, "t", fields)
    assert evolve_frame(before, fields).schema.simpleString() == people.read("t").schema.simpleString()
    assert as_rows(evolve_frame(before, fields)) == as_rows(people.read("t"))


@pytest.mark.parametrize(
    ("field", "message"),
    [
        (Field("1x", "INT64"), "invalid column name"),
        (Field("_table_x", "INT64"), "reserved prefix"),
        (Field("x", "NUMERIC(10,2)"), "invalid type"),
        (Field("x", "INT64", mode="MANY"), "invalid mode"),
        (Field("x", "INT64", alter="move"), "invalid alter"),
        (Field("x", "INT64", mode="REQUIRED", alter="insert"), "cannot be REQUIRED"),
        (Field("x", "INT64", alter="rename"), "needs alter_from"),
        (Field("x", "INT64", alter_from="y"), "goes only with alter='rename'"),
        (Field("x", "INT64", rounding_mode="ROUND_HALF_EVEN"), "only with NUMERIC"),
        (Field("x", "NUMERIC", rounding_mode="UP"), "rounding_mode must be"),
        (Field("x", "STRUCT"), "at least one nested field"),
        (Field("x", "STRUCT", fields=(Field("", "INT64"),)), "invalid column name"),
    ],
)
def test_field_rules(field, message):
    assert any(message in p for p in sc.problems([field]))


def test_list_rules():
    assert sc.problems([]) == ["the schema needs at least one column"]
    assert any("duplicate" in p for p in sc.problems([Field("a", "INT64"), Field("A", "STRING")]))
    assert sc.problems([Field("a", "INT64"), Field("A", "STRING", alter="delete")]) == []
    assert any("does not exist" in p for p in sc.problems([Field("a", "INT64")], existing=["b"]))
    assert any("needs an existing table" in p for p in sc.problems([Field("a", "INT64", alter="delete")], creating=True))


def test_required_columns_are_enforced_on_write(spark, warehouse):
    fields = [Field("id", "INT64", mode="REQUIRED"), Field("x", "NUMERIC", rounding_mode="ROUND_HALF_EVEN")]
    good = spark.createDataFrame([(1, 0.5)], "id int, x double")
    warehouse.create("t", good, columns=columns_from_fields(fields))
    with pytest.raises(Exception, match="REQUIRED but holds NULL"):
        warehouse.append("t", spark.createDataFrame([(None, 0.5)], "id int, x double"))
    assert warehouse.read("t").count() == 1
    tie = spark.sql("SELECT 2 AS id, CAST('0.0000000005' AS DECIMAL(20,12)) AS x")
    warehouse.append("t", tie)
    assert warehouse.read("t").where("id = 2").first()["x"] == 0


def test_rounding_modes(spark):
    values = spark.sql("SELECT CAST(v AS DECIMAL(20,12)) AS v FROM VALUES ('0.0000000015'), ('0.0000000025'), ('-0.0000000025') t(v)")
    got = values.select(
        (sc.round_numeric(F.col("v"), "ROUND_HALF_AWAY_FROM_ZERO") * 1000000000).cast("int"),
        (sc.round_numeric(F.col("v"), "ROUND_HALF_EVEN") * 1000000000).cast("int"),
    )
    assert [tuple(r) for r in got.collect()] == [(2, 2), (3, 2), (-3, -2)]


def test_type_names(spark):
    aliases = {"int": "INT64", "TinyInt": "INT64", "float": "FLOAT64", "decimal": "NUMERIC", "BIGDECIMAL": "BIGNUMERIC",
               "boolean": "BOOL", "record": "STRUCT", "NUMERIC(10,2)": "UNKNOWN", "MAP": "UNKNOWN"}
    assert {k: sc.canonical_type(k) for k in aliases} == aliases
    every = sorted(n for n in set(sc.TYPE_NAMES.values()) if n != "STRUCT")
    frame = sc.conform(spark.range(1), [Field("id", "INT64"), *[Field(f"c_{n}", n) for n in every]])
    back = {n: sc.live_type(frame.schema[f"c_{n}"].dataType) for n in every}
    assert {n: t for n, t in back.items() if n != t} == {"GEOGRAPHY": "STRING"}


def test_conform_nested_null_and_missing(spark):
    df = spark.sql("SELECT named_struct('a', 1) AS s, array(named_struct('b', 2)) AS r UNION ALL SELECT NULL, NULL")
    fields = [Field("s", "STRUCT", fields=(Field("a", "INT64"), Field("z", "STRING"))),
              Field("r", "STRUCT", mode="REPEATED", fields=(Field("y", "STRING"), Field("b", "FLOAT64"))),
              Field("absent", "DATE")]
    shaped = sc.conform(df, fields)
    rows = sorted(map(str, shaped.collect()))
    assert rows == [
        "Row(s=None, r=None, absent=None)",
        "Row(s=Row(a=1, z=None), r=[Row(y=None, b=2.0)], absent=None)",
    ]


def test_drift_and_contract_findings(spark):
    df = spark.sql("SELECT 1L AS id, 'a' AS snuck_in, array('x') AS tags")
    found = {(f.column, f.kind) for f in drift_findings([Field("ID", "INT64"), Field("tags", "STRING", mode="REPEATED")], df)}
    assert found == {("snuck_in", "extra")}
    declared = [Field("id", "STRING"), Field("later", "INT64", alter="insert"), Field("list", "INT64", mode="REPEATED"),
                Field("must", "INT64"), Field("tags", "STRING")]
    found = {(f.column, f.kind) for f in contract_findings(df, declared, "key", "day", ["id", "c"])}
    assert found == {("key", "unique_key_not_found"), ("day", "partition_by_not_found"), ("c", "cluster_by_not_found"),
                     ("snuck_in", "undeclared"), ("id", "type_mismatch"), ("must", "missing"), ("tags", "type_mismatch")}
    with pytest.raises(ContractError, match="must: missing"):
        check_contract(df, declared=declared)
    check_contract(df, unique_key="ID")


def test_drift_of_files_written_at_different_times(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    spark.range(2).withColumn("late", F.lit("x")).write.mode("append").parquet(str(tmp_path / "t"))
    report = file_drift([Field("id", "INT64"), Field("gone", "DATE")], spark, str(tmp_path / "t"))
    assert as_rows(report, "column_name", "kind", "affected_rows") == [("gone", "missing", 5), ("late", "extra", 2)]
