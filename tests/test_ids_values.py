import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgraph.functions.ids import ID_NAMESPACE, node_key, node_key_skipping_nulls, uuid5
from flowgraph.functions.values import (
    fill_template,
    format_cell,
    format_value,
    json_object,
    pad_item,
    present,
    strip_text,
    strip_zeros,
)
from flowgraph.specs import RAW_TABLES, json_key, promoted_columns


def one(spark, col, **values):
    schema = T.StructType([T.StructField(k, T.StringType()) for k in values])
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first()["x"]


def test_uuid5_equals_the_library(spark):
    names = ["HAS_ITEM", "SalesOrder:740506", "", "Größe|é→", "x" * 200] + [f"k{i}" for i in range(200)]
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", uuid5("name").alias("id"))
    for r in got.collect():
        assert r["id"] == str(uuid.uuid5(uuid.UUID(ID_NAMESPACE), r["name"]))
    assert one(spark, uuid5("a"), a="HAS_ITEM") == "caccffac-b24d-5a4c-8380-13dfbc68cc68"
    assert one(spark, uuid5("a"), a=None) is None


def test_keys_and_nulls(spark):
    assert one(spark, node_key("SalesOrderItem", "a", "b"), a="1", b="10") == "SalesOrderItem:1|10"
    assert one(spark, node_key("SalesOrderItem", "a", "b"), a="1", b=None) is None
    assert one(spark, node_key_skipping_nulls("J", "a", "b"), a=None, b="2") == "J:|2"


def test_present_drops_null_and_empty(spark):
    rows = spark.createDataFrame([("a", "b"), ("", "b"), (None, "b"), ("a", "")], "x string, y string")
    assert rows.where(present("x", "y")).count() == 1


def test_item_padding(spark):
    assert one(spark, strip_zeros("a"), a="000010") == "10"
    assert one(spark, strip_zeros("a"), a="000000") == ""
    assert one(spark, pad_item("a"), a="10") == "000010"
    assert one(spark, pad_item("a"), a="1234567") == "123456"


def test_text_helpers(spark):
    assert one(spark, strip_text(F.col("a")), a="\t\n  x y  ") == "x y"
    assert one(spark, fill_template("SO Item {a}/{b}"), a="1", b="2") == "SO Item 1/2"
    assert one(spark, fill_template("SO {a}"), a=None) is None
    text = one(spark, json_object({"first": "a", "second": "b"}), a='q"é', b=None)
    assert list(json.loads(text).items()) == [("first", 'q"é'), ("second", None)]


def test_formatting(spark):
    row = spark.sql(
        "SELECT CAST(NULL AS int) n, true t, array(1, NULL, 3) short, sequence(1, 7) long,"
        " named_struct('a', 1, 'b', CAST(NULL AS int)) obj"
    )
    types = {f.name: f.dataType for f in row.schema.fields}
    cells = row.select(*[format_cell(F.col(c), t).alias(c) for c, t in types.items()]).first()
    tips = row.select(*[format_value(F.col(c), t).alias(c) for c, t in types.items()]).first()
    assert cells.asDict() == {"n": "", "t": "true", "short": "[1,null,3]", "long": "[1,2,3,4,5,6,7]", "obj": '{"a":1,"b":null}'}
    assert tips.asDict() == {"n": "", "t": "true", "short": "[1, , 3]", "long": "[7 items]", "obj": '{"a":1,"b":null}'}


def test_model_size():
    assert len(RAW_TABLES) == 19
    assert sum(len(promoted_columns(t)) for t in RAW_TABLES) == 147
    assert json_key("last_change_datetime") == "lastChangeDateTime"
    assert json_key("date_of_last_posted_cnt_un_rstrcd_stk") == "dateOfLastPostedCntUnRstrcdStk"
