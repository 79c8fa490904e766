"""Running queries: null logic, literals, paths, relations, plans, streams."""

import re
import time
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern import Catalog, Engine, Query, QueryError, Regex, check_aggregate, parse_url, register, write

USER = "id long, name string, age int, score double, price decimal(10,2), active boolean, seen timestamp_ntz, day date, client struct<age:int,phone:string>, items array<struct<status:string,qty:int>>, tags array<string>, props map<string,int>"
ROWS = [
    (1, "Ann", 30, 1.5, Decimal("9.99"), True, datetime(2024, 1, 15), date(2024, 1, 15), (40, "x"), [("ok", 1), ("no", 2)], ["a", "b"], {"k": 1}),
    (2, "bob", None, 2.5, Decimal("10.00"), False, datetime(2024, 2, 1, 12), date(2024, 2, 1), (None, None), [], [], {}),
    (3, None, 50, None, None, None, None, None, None, None, None, None),
    (4, "Ann Lee", 18, -3.0, Decimal("0.50"), True, datetime(2023, 5, 5), date(2023, 5, 5), (18, "y"), [("no", 5)], ["c"], {"k": 5, "z.z": 2}),
]


@pytest.fixture(scope="module")
def engines(spark):
    users = spark.createDataFrame(ROWS, USER).cache()
    posts = spark.createDataFrame([(10, 1, "p", 5), (11, 1, "d", 7), (12, 1, "p", 7), (13, 4, "p", 1), (14, None, "p", 9)], "pid long, owner long, status string, n int")
    notes = spark.createDataFrame([(100, 10, "hi"), (101, 10, "yo"), (102, 13, "x")], "nid long, post long, body string")
    catalog = Catalog(spark).add("users", users, ("id",)).add("posts", posts, ("pid",)).add("notes", notes, ("nid",))
    catalog.relate("users", "posts", "posts", {"id": "owner"}, many=True).relate("posts", "owner_user", "users", {"owner": "id"}).relate("posts", "notes", "notes", {"pid": "post"}, many=True)
    catalog.relate("users", "first_post", "posts", {"id": "owner"}, unique=False)
    catalog.hook("$older", lambda df, v: df.filter(F.col("age") > int(v)))
    return {mode: Engine(catalog, mode) for mode in ("sql", "document")}


def ids(engine, query, entity="users", key="id"):
    return sorted(r[key] for r in engine.query(entity, query).df.collect())


FILTERS = [
    ("age=30", [1], [1]),
    ("age!=30", [3, 4], [2, 3, 4]),
    ("!(age=30)", [3, 4], [2, 3, 4]),
    ("age=null", [2], [2]),
    ("age!=null", [1, 3, 4], [1, 3, 4]),
    ("age{30,null}", [1, 2], [1, 2]),
    ("age!{30,null}", [3, 4], [3, 4]),
    ("age!{30}", [3, 4], [2, 3, 4]),
    ("age=abc", [], []),
    ("age!=abc", [1, 3, 4], [1, 2, 3, 4]),
    ("age!{abc}", [1, 3, 4], [1, 2, 3, 4]),
    ("age='30'&score<2", [1], [1]),
    ("age<30.5", [1, 4], [1, 4]),
    ("age>99999999999999999999", [], []),
    ("price=10", [2], [2]),
    ("price>9.98&price<=10", [1, 2], [1, 2]),
    ("active=true", [1, 4], [1, 4]),
    ("active!=true", [2], [2, 3]),
    ("name~=/^ann/i", [1, 4], [1, 4]),
    ("name~='/^ann/gi'&name~=Lee", [4], [4]),
    ("!(name~=/^ann/i)", [2], [2, 3]),
    ("seen>='2024-01-15T00:00:00Z'", [1, 2], [1, 2]),
    ("'2024-01-01'<=day<'2024-02-01'", [1], [1]),
    ("day='2024-02-01'", [2], [2]),
    ("$exists=client.phone", [1, 4], [1, 4]),
    ("$!exists=client.phone", [2, 3], [2, 3]),
    ("client.age>=18&items.0.status=ok", [1], [1]),
    ("items.1.qty=2", [1], [1]),
    ("items.status=no", [1, 4], [1, 4]),
    ("items.status!=ok", [2, 4], [2, 3, 4]),
    ("tags=c^tags{a,z}", [1, 4], [1, 4]),
    ("props.k>0&props.k<3", [1], [1]),
    ("id{1,2}&(age=30^score=2.5)", [1, 2], [1, 2]),
]


@pytest.mark.parametrize("text,sql,document", FILTERS)
def test_filters_in_both_null_modes(engines, text, sql, document):
    assert ids(engines["sql"], text) == sql
    assert ids(engines["document"], text) == document


def test_filters_of_dicts(engines):
    for filter, expected in [({"name": Regex("^a", "i")}, [1, 4]), ({"name": {"$in": [Regex("^b"), "Ann"]}}, [1, 2]), ({"seen": {"$gt": datetime(2024, 1, 20)}}, [2]), ({"day": date(2023, 5, 5)}, [4]), ({"price": Decimal("0.5")}, [4]), ({"age": {"$in": []}}, []), ({"age": {"$nin": []}}, [1, 2, 3, 4]), ({"$and": []}, [1, 2, 3, 4]), ({"$or": []}, [])]:
        assert ids(engines["sql"], {"filter": filter}) == expected


@pytest.mark.parametrize(
    "query",
    ["nope=1", "client.nope=1", "age>abc", "$select=nope", "$sort=nope", "$groupBy=nope", "$select=frob(age)", "$select=sum(*)", "$select=name,sum(age)", "$having=n>1", "$select=count(*):n&$having=m>1", "$with=nope", "$with=posts&$groupBy=name", "name~=/x/q", "$select=sum(age):x,avg(age):x", "$with=posts($with=nope)", {"filter": {"age": {"$foo": 1}}}, {"filter": {"age": {"$exists": 1}}}, {"filter": {"age": {"$in": 5}}}, {"controls": {"$limit": -1}}, {"controls": {"$sort": {"age": 2}}}, {"controls": {"$select": {"age": 2}}}, {"bogus": 1}],
)
def test_what_can_not_run_is_refused_before_it_runs(engines, query):
    with pytest.raises((QueryError, SyntaxError)):
        engines["sql"].query("users", query)


def test_projection(engines):
    engine = engines["sql"]
    assert engine.query("users", "$select=client.age,id").df.columns == ["client.age", "id"]
    assert engine.query("users", "$select=-client.age,-props").df.schema["client"].dataType.fieldNames() == ["phone"]
    assert engine.query("users", "$select=id,name,-name").df.columns == ["id"]
    assert [r.id for r in engine.query("users", "$sort=-age&$select=id&$limit=2").df.collect()] == [3, 1]


def test_groups(engines):
    engine = engines["sql"]
    assert engine.query("users", "id=99&$select=count(*),sum(age)").df.collect() == [(0, None)]
    register("spread", lambda c: F.max(c) - F.min(c))
    assert engine.query("users", "$select=spread(age):d,stddev(age)").df.columns == ["d", "stddev_age"]
    out = engine.query("users", "$select=sum(client.age),active&$groupBy=active&$having=sum_client.age>0&$sort=-sum_client.age")
    assert [tuple(r) for r in out.df.collect()] == [(True, 58)] or out.df.columns == ["active", "sum_client.age"]
    assert engine.query("users", "$groupBy=active&$limit=1").count() == 3
    check_aggregate(parse_url("$select=active,sum(age)&$groupBy=active"), ["active"], ["age"])
    for bad in ("$select=sum(age)", "$select=sum(name)&$groupBy=active", "$groupBy=age", "$groupBy=active&$with=posts"):
        with pytest.raises(QueryError):
            check_aggregate(parse_url(bad), ["active"], ["age"])


def test_relations(engines):
    engine = engines["sql"]
    out = {r.id: r.posts for r in engine.query("users", "$select=id&$with=posts($sort=-n&$skip=0&$limit=2&$select=pid)").df.collect()}
    assert {k: [x.pid for x in v] for k, v in out.items()} == {1: [11, 12], 2: [], 3: [], 4: [13]}
    out = engine.query("posts", "$select=pid&$with=owner_user($select=name)&$sort=-pid&$limit=2").df.collect()
    assert [(r.pid, r.owner_user and r.owner_user.name) for r in out] == [(14, None), (13, "Ann Lee")]
    nested = engine.query("users", "id=1&$with=posts(status=p&$with=notes($sort=-nid),owner_user($select=id))&$select=id").df.first()
    assert [(p.pid, [n.body for n in p.notes], p.owner_user.id) for p in sorted(nested.posts)] == [(10, ["yo", "hi"], 1), (12, [], 1)]
    agg = engine.query("users", "$select=id&$with=posts($select=status,sum(n):t&$groupBy=status&$having=t>6&$sort=-t)").df
    assert {r.id: [tuple(x) for x in r.posts] for r in agg.collect()} == {1: [("p", 12), ("d", 7)], 2: [], 3: [], 4: []}
    first = engine.query("users", "$select=id&$with=first_post($sort=-n)").df.collect()
    assert {r.id: r.first_post and r.first_post.pid for r in first} == {1: 11, 2: None, 3: None, 4: 13}
    with pytest.raises(QueryError):
        Engine(engine.catalog, max_depth=1).query("users", "$with=posts($with=notes)")


def test_counts_and_hooks(engines):
    result = engines["sql"].query("users", "$older=20&$count&$limit=1&$skip=0&$unknown=1")
    assert result.count() == 2 and len(result.df.collect()) == 1
    with pytest.raises(QueryError):
        Engine(engines["sql"].catalog, policy={"age": ["$eq"]}).query("users", "age>1")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    engine = Engine(Catalog(spark).read("orders", f"{sf_dir}/orders.parquet"))
    text = plan(engine.query("orders", "o_totalprice>1000&o_orderdate>='1996-01-01'&o_orderstatus{F,O}&$select=o_orderkey").df)
    assert "GreaterThan(o_totalprice,1000.0)" in text and "GreaterThanOrEqual(o_orderdate" in text and "In(o_orderstatus" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in text
    assert "TakeOrderedAndProject" in plan(engine.query("orders", "$sort=-o_totalprice&$skip=3&$limit=5").df)


def test_pages_per_parent_are_cut_before_they_are_shuffled(spark, sf_dir):
    catalog = Catalog(spark).read("orders", f"{sf_dir}/orders.parquet", key=("o_orderkey",)).read("customer", f"{sf_dir}/customer.parquet", key=("c_custkey",))
    catalog.relate("customer", "orders", "orders", {"c_custkey": "o_custkey"}, many=True)
    assert "WindowGroupLimit" in plan(Engine(catalog).query("customer", "$with=orders($sort=-o_totalprice&$limit=3)").df)
    few = plan(Engine(catalog).query("customer", "$sort=c_custkey&$limit=5&$with=orders").df)
    assert "LeftSemi" in few and "Broadcast" in few


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, kind string")
    write(rows, str(tmp_path / "in"))
    engine = Engine(Catalog(spark).add("events", lambda s: s.readStream.schema("id long, kind string").parquet(str(tmp_path / "in"))))

    def ran(text):
        result = engine.query("events", text)
        query = result.df.writeStream.outputMode(result.mode).format("memory").queryName("seen").start()
        query.processAllAvailable()
        query.stop()
        return sorted(tuple(r) for r in spark.table("seen").collect())

    assert ran("id>1&$select=id") == [(2,), (3,)]
    assert ran("$select=kind,count(*):n&$groupBy=kind&$having=n>1&$sort=-n") == [("a", 2)]
    for bad in ("$skip=1", "$sort=id", "$count"):
        with pytest.raises(QueryError):
            engine.query("events", bad)


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, format):
    write(spark.createDataFrame([(1, "x"), (2, "y")], "id long, kind string"), str(tmp_path / "t"), format, **({"header": "true"} if format == "csv" else {}))
    options = {"header": "true", "schema": "id long, kind string"} if format == "csv" else {}
    assert ids(Engine(Catalog(spark).read("t", str(tmp_path / "t"), format, **options)), "kind=y", "t") == [2]
    with pytest.raises(QueryError):
        Catalog(spark).read("t", "x", "exe")


def test_moments_without_a_zone_are_the_sessions(spark, monkeypatch):
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        rows = spark.sql("select 1 id, timestamp'2024-01-15 00:00:00 UTC' ts, date'2024-01-15' day union all select 2, timestamp'2024-01-15 05:00:00 UTC', date'2024-01-16'")
        engine = Engine(Catalog(spark).add("t", rows))
        for text, found in {"ts='2024-01-15'": [1], "ts{'2024-01-15 05:00:00'}": [2], "ts>='2024-01-15T01:00:00'": [2], "ts<'2024-01-15T00:00:01Z'": [1], "day>'2024-01-15T12:00:00'": [2], "ts<'2024-01-15T02:00:00+02:00'": []}.items():
            assert ids(engine, text, "t") == found, text
        assert ids(engine, {"filter": {"ts": datetime(2024, 1, 15)}}, "t") == [1]
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert ids(engine, "ts='2024-01-15'", "t") == [2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        monkeypatch.undo()
        time.tzset()


def test_limited_parents_have_a_total_order_and_without_a_key_one_plan(spark, sf_dir):
    def text(key):
        catalog = Catalog(spark).read("orders", f"{sf_dir}/orders.parquet", key=("o_orderkey",)).read("customer", f"{sf_dir}/customer.parquet", key=key)
        catalog.relate("customer", "orders", "orders", {"c_custkey": "o_custkey"}, many=True)
        return plan(Engine(catalog).query("customer", "$sort=c_mktsegment&$limit=5&$with=orders").df)

    assert set(re.findall(r"TakeOrderedAndProject\(limit=5, orderBy=\[([^\]]*)\]", re.sub(r"#\d+L?", "", text(("c_custkey",))))) == {"c_mktsegment ASC NULLS FIRST,c_custkey ASC NULLS FIRST"}
    assert "LeftSemi" in text(("c_custkey",)) and "LeftSemi" not in text(()) and text(()).count("limit=5") == 1


def test_json_keeps_patterns_and_moments():
    query = parse_url("name~=/^a/i&$sort=-seen&$with=posts(n>1)")
    query.filter |= {"label": Regex("x/y", "s"), "seen": {"$gte": datetime(2024, 1, 2, 3), "$lt": date(2025, 1, 1)}}
    again = Query.from_json(query.to_json())
    assert again.filter == query.filter and again.as_dict() == query.as_dict()


def test_a_schema_is_read_once_and_files_each_time(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    engine = Engine(Catalog(spark).read("t", f"{tmp_path}/t"))
    assert engine.query("t", "").df.count() == 3
    spark.range(4).write.mode("append").parquet(f"{tmp_path}/t")
    assert engine.query("t", "id<100").df.count() == 7
