import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from webloom.job import Engine, submit
from webloom.operators import Bag, Pairs
from webloom.sources import kv, rowfiles

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
texts = st.lists(st.sampled_from(["a", "b", "c d", "", "é"]), max_size=8)


def bag(spark, values):
    return Bag.parallelize(spark, values)


def test_elementwise(spark):
    own = bag(spark, ["a b", "c", "c"])
    assert sorted(own.flat_map(lambda x: F.split(x, " ")).collect()) == ["a", "b", "c", "c"]
    assert sorted(own.filter(lambda x: x != "c").collect()) == ["a b"]
    assert sorted(own.map_to_pair(lambda x: F.nullif(x, F.lit("a b")), F.upper).collect()) == [("c", "C"), ("c", "C")]
    pairs = own.flat_map_to_pair(lambda x: F.transform(F.split(x, " "), lambda w: F.struct(w, x)))
    assert sorted(pairs.collect()) == [("a", "a b"), ("b", "a b"), ("c", "c"), ("c", "c")]
    assert sorted(pairs.flat_map(lambda k, v: F.array(k, v)).distinct().collect()) == ["a", "a b", "b", "c"]
    assert sorted(pairs.flat_map_to_pair(lambda k, v: F.array(F.struct(v, k))).collect())[0] == ("a b", "a")
    assert sorted(own.flat_map_python(lambda v: v.split() if v != "c" else 1 / 0, on_error="skip").collect()) == ["a", "b"]
    assert own.count() == 3 and len(own.take(2)) == 2 and len(own.take(9)) == 3
    assert own.sample(1.0, 1).count() == 3 and own.sample(0.0, 1).count() == 0
    assert sorted(own.group_by(lambda x: F.length(x)).collect()) == [(1, "c,c"), (3, "a b")]


def test_fold_uses_zero_for_each_partition_and_once_more(spark):
    own = Bag(spark.range(1, 4, 1, 3))
    assert own.fold(10, lambda a, b: a + b, "long") == 46
    assert own.fold(0, lambda a, b: a + b, "long") == 6 and Bag(spark.range(0)).fold(5, lambda a, b: a + b, "long") == 5


@few
@given(a=texts, b=texts)
def test_algebra(spark, a, b):
    x, y = bag(spark, a), bag(spark, b)
    assert sorted(x.distinct().distinct().collect()) == sorted(set(a))
    assert sorted(x.intersection(y).collect()) == sorted(y.intersection(x).collect()) == sorted(set(a) & set(b))
    p, q = (Pairs(spark.createDataFrame([(v, str(i)) for i, v in enumerate(z)], "k string, v string")) for z in (a, b))
    assert p.join(q).count() == sum(a.count(k) * b.count(k) for k in set(a))
    got = dict(p.cogroup(q).collect())
    assert got == {k: "[" + ",".join(sorted(str(i) for i, v in enumerate(a) if v == k)) + "],[" + ",".join(sorted(str(i) for i, v in enumerate(b) if v == k)) + "]" for k in {*a, *b}}
    assert p.count_keys() == len(set(a))
    assert dict(p.fold_by_key(F.count("v")).collect()) == {k: a.count(k) for k in a}


def test_destroyed_collections_raise(spark):
    own = bag(spark, ["a"])
    own.destroy()
    with pytest.raises(RuntimeError):
        own.count()


def test_keyed_tables(spark):
    table = spark.createDataFrame([("a", {"x": "1"}), ("b", {"y": "2"}), ("c", {})], "key string, values map<string,string>")
    assert [r.key for r in kv.scan(table, "a", "c").orderBy("key").collect()] == ["a", "b"] and kv.scan(table).count() == 3
    assert kv.get_cell(table, "a", "x").collect()[0].value == "1" and kv.get_cell(table, "a", "y").isEmpty() and kv.get_row(table, "z").isEmpty()
    assert kv.exists_row(table, "c") and not kv.exists_row(table, "z") and kv.count(table) == 3
    cells = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2")], "key string, column string, value string")
    puts = spark.createDataFrame([("a", "x", "9", "x", "1"), ("b", "x", "9", "x", "1"), ("b", "z", "7", "x", "2")], "key string, column string, value string, if_column string, equals string")
    assert sorted(map(tuple, kv.put_if(cells, puts).collect())) == [("a", "x", "9"), ("b", "x", "2"), ("b", "z", "7")]
    assert {r.key: r["values"] for r in kv.cells_to_rows(cells).collect()} == {"a": {"x": "1"}, "b": {"x": "2"}}
    page = kv.page(table, "a", 2).collect()
    assert [(r.key, r.next_key) for r in page] == [("a", "c"), ("b", "c")] and kv.page(table, "c", 2).collect()[0].next_key is None


def test_catalog_and_jobs(spark):
    def job(engine, args):
        engine.tables.write("seen", engine.parallelize(args).df)
        engine.output("a")
        engine.output(str(engine.from_table("seen", F.col("value")).count()))

    assert submit(spark, job, ["x", "y"]) == "a2" and submit(spark, lambda e, a: None) == "No output"
    tables = Engine(spark).tables
    with pytest.raises(FileExistsError):
        tables.rename("seen", "seen")
    tables.rename("seen", "kept")
    with pytest.raises(KeyError):
        tables.rename("seen", "other")
    assert tables.read("kept").count() == 2 and tables.read("seen") is None
    tables.delete("kept")
    tables.delete("kept")
    with pytest.raises(RuntimeError, match="ZeroDivisionError"):
        submit(spark, lambda e, a: 1 / 0)


def test_row_files(spark, tmp_path):
    (tmp_path / "k1").write_bytes(b"k1 url 5 a b c page 8 <p>\n</p> responseCode 3 200 ")
    (tmp_path / "k2").write_bytes(b"k2 url 1 z ")
    got = {r.key: r for r in rowfiles.read_crawl(spark, str(tmp_path)).collect()}
    assert (got["k1"].url, got["k1"].page, got["k1"].response_code) == ("a b c", "<p>\n</p>", 200)
    assert (got["k2"].url, got["k2"].page, got["k2"].length) == ("z", None, None)
    assert rowfiles.parse_row(b"") is None


def test_fold_of_many_pieces(spark):
    own = Bag(spark.range(0, 100_003, 1, 7).select(F.col("id")))
    assert own.fold(0, lambda a, b: a + b, "long") == 100_003 * 100_002 // 2
    assert own.fold(-1, lambda a, b: F.greatest(a, b), "long") == 100_002


def test_names_of_tables_stay_apart(spark):
    tables = kv.Catalog(spark)
    for name in ("pt-a-b", "pt-a_b", "pt-A-b", "mem-X", "pt-mem"):
        tables.delete(name)
    for k, name in enumerate(("pt-a-b", "pt-a_b", "pt-A-b", "mem-X")):
        tables.write(name, spark.createDataFrame([(str(k),)], "key string"))
    assert [tables.read(n).first().key for n in ("pt-a-b", "pt-a_b", "pt-A-b", "mem-X")] == ["0", "1", "2", "3"]
    assert {"pt-a-b", "pt-a_b", "pt-A-b", "mem-X"} <= set(tables.tables())
    tables.rename("mem-X", "pt-mem")
    assert tables.read("pt-mem").first().key == "3" and tables.exists("mem-X")
    for name in ("pt-a-b", "pt-a_b", "pt-A-b", "mem-X", "pt-mem"):
        tables.delete(name)
    assert not {"pt-a-b", "pt-mem", "mem-X"} & set(tables.tables())
