from datetime import datetime, timedelta

from pyspark.sql import functions as F

from heddle.operators.drift import promoted, rename_map, schema_changes, unified_table

SCHEMA = "file_id long, feed string, file_name string, exported_at timestamp, line_no int, payload string, field string, v string, wanted int, later int, side int, at int, key int"
DAY = datetime(2024, 1, 1)


def lines(spark, files):
    rows = []
    for fid, day, payloads in files:
        rows += [(fid, "m/index", "f", DAY + timedelta(days=day), i, p, "x", "y", 1, 1, 1, 1, 1) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    out = schema_changes(lines(spark, files), F.lit("name")).select("file_id", "change_kind", "field_before", "field_after")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_added_removed_retyped_in_order_of_time_then_file(spark):
    files = [(9, 0, ['{"name":"a","x":1}']), (3, 1, ['{"name":"a","x":1.0,"y":null}']), (2, 2, ['{"name":"a","y":"t"}'])]
    assert changes(spark, files) == {(3, "retyped", "x", "x"), (3, "added", "", "y"), (2, "removed", "x", ""), (2, "retyped", "y", "y")}


def test_rename_needs_equal_values_for_every_shared_record(spark):
    a = ['{"name":"a","x":1}', '{"name":"b","x":2}', '{"name":"c","x":null}', '{"name":"d"}']
    assert changes(spark, [(1, 0, a), (2, 1, ['{"name":"a","y":1}', '{"name":"c","y":5}', '{"name":"a","y":1}'])]) == {(2, "renamed", "x", "y")}
    assert changes(spark, [(1, 0, a), (2, 1, ['{"name":"a","y":1}', '{"name":"b","y":3}'])]) == {(2, "removed", "x", ""), (2, "added", "", "y")}
    assert changes(spark, [(1, 0, a), (2, 1, ['{"name":"z","y":1}'])]) == {(2, "removed", "x", ""), (2, "added", "", "y")}


def test_one_partner_each_and_object_values(spark):
    a, b = ['{"name":"a","x":{"p":1,"q":[2]},"w":7}'], ['{"name":"a","y":{"q":[2],"p":1},"v":7,"u":7}']
    assert changes(spark, [(1, 0, a), (2, 1, b)]) == {(2, "renamed", "x", "y"), (2, "renamed", "w", "u"), (2, "added", "", "v")}


def test_lines_that_are_no_objects_and_repeated_files(spark):
    junk = ["", "# note", "[1]", '"x"', '{"name":"a', None, "null"]
    assert changes(spark, [(1, 0, ['{"name":"a"}', *junk]), (2, 1, ['{"name":"a"}'] * 3), (3, 2, ['{"name":"a"}'])]) == set()
    assert changes(spark, [(1, 0, ['{"name":"a"}']), (2, 1, junk)]) == {(2, "removed", "name", "")}
    assert changes(spark, []) == set()


def test_unified_table_promotes_and_keeps_clashing_names(spark):
    files = [(1, 0, ['{"name":"a","n":1,"feed":"f","N":true}']), (2, 1, ['{"name":"b","n":1.5,"o":{"z":1}}']), (3, 2, ['{"name":"c","n":null,"o":"s"}'])]
    df = unified_table(lines(spark, files))
    assert dict(df.dtypes)["field_n"] == "decimal(2,1)" and dict(df.dtypes)["N"] == "boolean" and dict(df.dtypes)["o"] == "string" and "field_feed" in df.columns
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    assert sorted((r["name"], r["field_n"], r["o"]) for r in df.collect()) == [("a", 1.0, None), ("b", 1.5, '{"z":1}'), ("c", None, "s")]
    assert unified_table(lines(spark, [])).columns == ["feed", "file_id", "exported_at", "line_no"]


def test_lattice():
    assert [promoted(b) for b in (0, 1, 8, 3, 16, 32, 10)] == ["string", "boolean", "string", "string", "string", "string", "string"]
    assert [promoted(2, 5), promoted(2, 18), promoted(2, 23), promoted(4, 2, 3), promoted(6, 16, 1), promoted(6, 30, 9)] == ["bigint", "bigint", "decimal(23,0)", "decimal(5,3)", "decimal(17,1)", "string"]
    assert [promoted(4, inexact=True), promoted(4, 1, 1, True), promoted(6, 1, 0, True)] == ["double", "string", "string"]


def test_numbers_of_one_field_keep_every_digit(spark):
    def column(*numbers):
        df = unified_table(lines(spark, [(1, 0, [f'{{"name":"a","n":{n}}}' for n in numbers])]))
        return dict(df.dtypes)["n"], [str(r["n"]) for r in df.orderBy("line_no").collect()]

    assert column("9007199254740993", "0.5") == ("decimal(17,1)", ["9007199254740993.0", "0.5"])
    assert column("12345678901234567890123", "-7") == ("decimal(23,0)", ["12345678901234567890123", "-7"])
    assert column("100.0", "2") == ("decimal(3,0)", ["100", "2"])
    assert column("1" * 30, "0.0000000001") == ("string", ["1" * 30, "0.0000000001"])
    assert column("1e3", "2.5e-2") == ("double", ["1000.0", "0.025"])
    assert column("5", "-17") == ("bigint", ["5", "-17"])
    assert changes(spark, [(1, 0, ['{"name":"a","x":12345678901234567890123}']), (2, 1, ['{"name":"a","x":7}'])]) == set()


def test_lines_without_feed_or_file_belong_to_no_file(spark):
    df = lines(spark, [(1, 0, ['{"name":"a","x":1}']), (2, 1, ['{"name":"a","y":1}'])])
    more = df.unionByName(df.withColumn("feed", F.lit(None).cast("string"))).unionByName(df.withColumn("file_id", F.lit(None).cast("long")))
    assert schema_changes(more, F.lit("name")).count() == 1


def test_renamed_fields_share_a_column_unless_they_meet_in_a_file(spark):
    files = [(1, 0, ['{"name":"a","x":1,"u":5}']), (2, 1, ['{"name":"a","y":1,"u":5}']), (3, 2, ['{"name":"a","z":1,"v":5}']), (4, 3, ['{"name":"a","z":2.5,"u":6,"v":5}'])]
    df = lines(spark, files)
    names = rename_map(df, F.lit("name"))
    assert names == {"x": "z", "y": "z"}
    out = unified_table(df, names)
    assert [c for c in out.columns if c in "xyzuv"] == ["u", "v", "z"] and sorted(float(r["z"]) for r in out.collect()) == [1.0, 1.0, 1.0, 2.5]
    assert rename_map(lines(spark, []), F.lit("name")) == {}
