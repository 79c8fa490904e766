"""The registered queries over the test tables: an entity, its query text, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.predicates import ToSql
from quern.plans.compile import Engine, Result
from quern.plans.ir import Query, Regex
from quern.plans.walk import get_insights, walk
from quern.sources.catalog import Catalog
from quern.sources.url import parse_filter, parse_url
from quern.sources.url_builder import build_url

#: The tables' keys, which break ties of order within a relation.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id"}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The tables and how they relate."""
    out = Catalog(spark)
    for name in (*KEYS, "lineitem"):
        out.read(name, f"{sf_dir}/{name}.parquet", key=(KEYS[name],) if name in KEYS else ())
    out.add("events_json", lambda s: s.read.parquet(f"{sf_dir}/events.parquet").withColumn("props", F.from_json("props", "k int")), key=("event_id",))
    out.add("events_at", lambda s: s.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), key=("event_id",))
    out.add("labelled", lambda s: s.read.parquet(f"{sf_dir}/documents.parquet").join(s.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left"), key=("doc_id",))
    out.add("customer_nested", lambda s: s.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.struct("c_name", F.col("c_acctbal").alias("balance")).alias("info"), F.array(F.struct(F.col("c_mktsegment").alias("segment"))).alias("items")))
    out.relate("region", "nations", "nation", {"r_regionkey": "n_regionkey"}, many=True)
    out.relate("nation", "region", "region", {"n_regionkey": "r_regionkey"})
    out.relate("nation", "suppliers", "supplier", {"n_nationkey": "s_nationkey"}, many=True)
    out.relate("nation", "customers", "customer", {"n_nationkey": "c_nationkey"}, many=True)
    out.relate("customer", "nation", "nation", {"c_nationkey": "n_nationkey"})
    out.relate("customer", "orders", "orders", {"c_custkey": "o_custkey"}, many=True)
    out.relate("orders", "customer", "customer", {"o_custkey": "c_custkey"})
    out.relate("orders", "lineitems", "lineitem", {"o_orderkey": "l_orderkey"}, many=True)
    out.relate("lineitem", "part", "part", {"l_partkey": "p_partkey"})
    out.relate("lineitem", "supplier", "supplier", {"l_suppkey": "s_suppkey"})
    out.relate("documents", "labels", "labels", {"doc_id": "doc_id"})
    out.relate("labels", "document", "documents", {"doc_id": "doc_id"})
    out.hook("$sample_status", lambda df, value: df.filter(F.col("o_orderstatus") == value))
    return out


@dataclass(frozen=True)
class Registered:
    """then: what makes flat rows of a result, for comparing. null_mode: of the engine."""

    entity: str
    query: str | dict | Query
    sql: str
    then: Callable[[Result], DataFrame] | None = None
    null_mode: str = "sql"


def rounded(*names: str, digits: int = 2) -> Callable[[Result], DataFrame]:
    return lambda r: r.df.withColumns({n: F.round(n, digits) for n in names})


def flat(relation: str, *columns: str, outer: str = "") -> Callable[[Result], DataFrame]:
    """One row per element of a to-many relation."""
    return lambda r: r.df.select(*outer.split(), F.explode(relation).alias("_x")).select(*outer.split(), *[F.col(f"_x.{c}") for c in columns])


#: By name. The text of a query is what a user would write after the ? of a URL.
WORKLOAD: dict[str, Registered] = {
    "filter_eq": Registered("orders", "o_orderstatus=F", "select * from orders where o_orderstatus='F'"),
    "filter_ne": Registered("orders", "o_orderstatus!=F", "select * from orders where o_orderstatus<>'F'"),
    "filter_gt": Registered("orders", "o_totalprice>400000&$select=o_orderkey", "select o_orderkey from orders where o_totalprice>400000"),
    "filter_gte": Registered("lineitem", "l_quantity>=49&$select=l_orderkey,l_quantity", "select l_orderkey,l_quantity from lineitem where l_quantity>=49"),
    "filter_lt": Registered("part", "p_size<5&$select=p_partkey", "select p_partkey from part where p_size<5"),
    "filter_lte": Registered("part", "p_retailprice<=905.5&$select=p_partkey", "select p_partkey from part where p_retailprice<=905.5"),
    "filter_in": Registered("customer", "c_mktsegment{BUILDING,MACHINERY}", "select * from customer where c_mktsegment in ('BUILDING','MACHINERY')"),
    "filter_nin": Registered("orders", "o_orderpriority!{'1-URGENT','4-NOT SPECIFIED'}&$select=o_orderkey", "select o_orderkey from orders where o_orderpriority not in ('1-URGENT','4-NOT SPECIFIED')"),
    "filter_regex": Registered("part", "p_name~=/^red/&$select=p_partkey,p_name", "select p_partkey,p_name from part where regexp_matches(p_name,'^red')"),
    "filter_regex_flags": Registered("part", "p_name~=/WIDGET$/i&$select=p_partkey,p_name", "select p_partkey,p_name from part where regexp_matches(p_name,'WIDGET$','i')"),
    "filter_regex_value": Registered("part", {"filter": {"p_name": Regex("WIDGET$", "i")}, "controls": {"$select": ["p_partkey"]}}, "select p_partkey from part where regexp_matches(p_name,'WIDGET$','i')"),
    "filter_exists": Registered("events", "$exists=value&$select=event_id", "select event_id from events where value is not null"),
    "filter_not_exists": Registered("labelled", "$!exists=quality&$select=doc_id", "select d.doc_id from documents d left join labels l on d.doc_id=l.doc_id where l.quality is null"),
    "filter_eq_null": Registered("labelled", "quality=null&$select=doc_id", "select d.doc_id from documents d left join labels l on d.doc_id=l.doc_id where l.quality is null"),
    "filter_ne_null": Registered("labelled", "quality!=null&$select=doc_id", "select d.doc_id from documents d left join labels l on d.doc_id=l.doc_id where l.quality is not null"),
    "filter_in_null": Registered("labelled", "quality{0,null}&$select=doc_id", "select d.doc_id from documents d left join labels l on d.doc_id=l.doc_id where l.quality=0 or l.quality is null"),
    "filter_unfit": Registered("orders", "o_orderkey!=abc&$select=o_orderkey", "select o_orderkey from orders"),
    "filter_object": Registered("orders", {"filter": {"$and": [{"$or": [{"o_orderstatus": "F"}, {"o_orderstatus": "P"}]}, {"o_totalprice": {"$gte": 1000, "$lte": 90000}}]}, "controls": {"$select": ["o_orderkey"]}}, "select o_orderkey from orders where o_orderstatus in ('F','P') and o_totalprice between 1000 and 90000"),
    "null_sql": Registered("labelled", "!(quality=1)&$select=doc_id", "select d.doc_id from documents d left join labels l on d.doc_id=l.doc_id where not(l.quality=1)"),
    "null_document": Registered("labelled", "quality!=1&toxic!{1}&$select=doc_id", "select d.doc_id from documents d left join labels l on d.doc_id=l.doc_id where l.quality is distinct from 1 and l.toxic is distinct from 1", null_mode="document"),
    "between_excl": Registered("events", "10<value<20&$select=event_id,value", "select event_id,value from events where value>10 and value<20"),
    "between_incl": Registered("part", "10<=p_size<=20&$select=p_partkey", "select p_partkey from part where p_size>=10 and p_size<=20"),
    "between_mixed": Registered("part", "10<p_size<=20&$select=p_partkey", "select p_partkey from part where p_size>10 and p_size<=20"),
    "between_ts": Registered("orders", "'1996-01-01'<=o_orderdate<'1996-07-01'&$select=o_orderkey", "select o_orderkey from orders where o_orderdate>=timestamp '1996-01-01' and o_orderdate<timestamp '1996-07-01'"),
    "moment_zone": Registered("events_at", "'2024-01-02'<=ts<'2024-01-05T12:30:00'&$select=event_id", "select event_id from events where ts>=timestamp '2024-01-02' and ts<timestamp '2024-01-05 12:30:00'"),
    "multi_op": Registered("orders", "o_totalprice>=1000&o_totalprice<=2000&$select=o_orderkey", "select o_orderkey from orders where o_totalprice>=1000 and o_totalprice<=2000"),
    "or_precedence": Registered("orders", "o_totalprice>450000^o_orderstatus=P&o_totalprice<5000&$select=o_orderkey", "select o_orderkey from orders where o_totalprice>450000 or (o_orderstatus='P' and o_totalprice<5000)"),
    "grouping": Registered("orders", "(o_totalprice>450000^o_totalprice<5000)&o_orderstatus=P&$select=o_orderkey", "select o_orderkey from orders where (o_totalprice>450000 or o_totalprice<5000) and o_orderstatus='P'"),
    "not_or": Registered("orders", "!(o_orderstatus=F^o_totalprice<200000)&$select=o_orderkey", "select o_orderkey from orders where not (o_orderstatus='F' or o_totalprice<200000)"),
    "not_not": Registered("orders", "!(!(o_totalprice>450000))&$select=o_orderkey", "select o_orderkey from orders where not(not(o_totalprice>450000))"),
    "same_op": Registered("orders", "o_totalprice>100&o_totalprice>450000&$select=o_orderkey", "select o_orderkey from orders where o_totalprice>100 and o_totalprice>450000"),
    "select_include": Registered("customer", "$select=c_name,c_custkey", "select c_name,c_custkey from customer"),
    "select_exclude": Registered("customer", "$select=-c_acctbal", "select c_custkey,c_name,c_nationkey,c_mktsegment from customer"),
    "select_mixed": Registered("customer", "$select=c_custkey,c_name,-c_acctbal", "select c_custkey,c_name from customer"),
    "sort_skip_limit": Registered("orders", "$sort=-o_totalprice,o_orderkey&$skip=40&$limit=20&$select=o_orderkey,o_totalprice", "select o_orderkey,o_totalprice from orders order by o_totalprice desc,o_orderkey limit 20 offset 40"),
    "sort_unselected": Registered("orders", "$order=-o_totalprice,o_orderkey&$top=15&$select=o_orderkey", "select o_orderkey from orders order by o_totalprice desc,o_orderkey limit 15"),
    "count_total": Registered("orders", "o_orderstatus=F&$count&$limit=5", "select count(*) as count from orders where o_orderstatus='F'", lambda r: r.total()),
    "agg_all": Registered("events", "$select=count(*),count(value),sum(value):s,avg(value):a,min(value):mi,max(value):ma", "select count(*) count_star,count(value) count_value,round(sum(value),2) s,round(avg(value),6) a,min(value) mi,max(value) ma from events", lambda r: r.df.withColumns({"s": F.round("s", 2), "a": F.round("a", 6)})),
    "group_agg": Registered("orders", "$select=o_orderstatus,sum(o_totalprice):total,count(*)&$groupBy=o_orderstatus", "select o_orderstatus,round(sum(o_totalprice),2) total,count(*) count_star from orders group by 1", rounded("total")),
    "group_multi": Registered("lineitem", "$select=l_returnflag,l_linestatus,count(*):n&$groupBy=l_returnflag,l_linestatus", "select l_returnflag,l_linestatus,count(*) n from lineitem group by 1,2"),
    "group_only": Registered("orders", "$groupBy=o_orderstatus,o_orderpriority", "select distinct o_orderstatus,o_orderpriority from orders"),
    "custom_fn": Registered("events", "$select=event_type,stddev(value):sd,count_distinct(user_id):users&$groupBy=event_type", "select event_type,round(stddev(value),6) sd,count(distinct user_id) users from events group by 1", rounded("sd", digits=6)),
    "having": Registered("orders", "$select=o_custkey,count(*):n&$groupBy=o_custkey&$having=n>18", "select o_custkey,count(*) n from orders group by 1 having count(*)>18"),
    "having_or": Registered("orders", "$select=o_custkey,count(*):n,sum(o_totalprice):t&$groupBy=o_custkey&$having=n>20^t>5500000", "select o_custkey,count(*) n,round(sum(o_totalprice),2) t from orders group by 1 having count(*)>20 or sum(o_totalprice)>5500000", rounded("t")),
    "having_not": Registered("events", "$select=event_type,count(*):n&$groupBy=event_type&$having=!(n<2000)", "select event_type,count(*) n from events group by 1 having not(count(*)<2000)"),
    "having_repeated": Registered("orders", "$select=o_custkey,count(*):n&$groupBy=o_custkey&$having=n>10&$having=n<13", "select o_custkey,count(*) n from orders group by 1 having count(*)>10 and count(*)<13"),
    "topk": Registered("events", "$select=user_id,count(*):n&$groupBy=user_id&$sort=-n,user_id&$limit=10", "select user_id,count(*) n from events group by 1 order by n desc,user_id limit 10"),
    "custom_control": Registered("orders", "$sample_status=P&$unknown=x&$select=o_orderkey", "select o_orderkey from orders where o_orderstatus='P'"),
    "path_json": Registered("events_json", "props.k>50&$select=event_id", "select event_id from events where cast(json_extract(props,'$.k') as int)>50"),
    "path_nested": Registered("customer_nested", "info.balance>5000&items.0.segment=BUILDING&items.segment!=MACHINERY&$select=c_custkey,info.c_name", 'select c_custkey,c_name as "info.c_name" from customer where c_acctbal>5000 and c_mktsegment=\'BUILDING\''),
    "with_one": Registered("orders", "o_orderstatus=F&$select=o_orderkey&$with=customer($select=c_name,c_mktsegment)", "select o_orderkey,c_name,c_mktsegment from orders left join customer on o_custkey=c_custkey where o_orderstatus='F'", lambda r: r.df.select("o_orderkey", "customer.c_name", "customer.c_mktsegment")),
    "with_sparse": Registered("documents", "$select=doc_id&$with=labels(quality=1)", "select d.doc_id,l.quality,l.toxic from documents d left join (select * from labels where quality=1) l on d.doc_id=l.doc_id", lambda r: r.df.select("doc_id", "labels.quality", "labels.toxic")),
    "with_many": Registered("nation", "$select=n_nationkey&$with=suppliers($select=s_suppkey)", "select n_nationkey,s_suppkey from nation join supplier on s_nationkey=n_nationkey", flat("suppliers", "s_suppkey", outer="n_nationkey")),
    "with_many_empty": Registered("customer", "$select=c_custkey&$with=orders(o_totalprice>499000)", "select c_custkey,(select count(*) from orders where o_custkey=c_custkey and o_totalprice>499000) n from customer", lambda r: r.df.select("c_custkey", F.size("orders").cast("long").alias("n"))),
    "with_many_limit": Registered("customer", "$with=orders($sort=-o_totalprice,o_orderkey&$limit=3)", "select c_custkey,o_orderkey,o_totalprice from customer join (select * from orders qualify row_number() over(partition by o_custkey order by o_totalprice desc,o_orderkey)<=3) on c_custkey=o_custkey", flat("orders", "o_orderkey", "o_totalprice", outer="c_custkey")),
    "with_many_page": Registered("customer", "$sort=-c_acctbal,c_custkey&$limit=50&$select=c_custkey&$with=orders($sort=-o_totalprice&$skip=2&$limit=3&$select=o_orderkey)", "select c_custkey,o_orderkey from (select c_custkey from customer order by c_acctbal desc,c_custkey limit 50) join (select *,row_number() over(partition by o_custkey order by o_totalprice desc,o_orderkey) r from orders) on c_custkey=o_custkey where r>2 and r<=5", flat("orders", "o_orderkey", outer="c_custkey")),
    "with_limit_ties": Registered("customer", "$sort=c_mktsegment&$limit=40&$select=c_custkey&$with=orders($select=o_orderkey)", "select c_custkey,o_orderkey from (select c_custkey from customer order by c_mktsegment,c_custkey limit 40) join orders on c_custkey=o_custkey", flat("orders", "o_orderkey", outer="c_custkey")),
    "with_shorthand": Registered("nation", {"controls": {"$select": ["n_nationkey"], "$with": ["region"]}}, "select n_nationkey,r_name from nation join region on n_regionkey=r_regionkey", lambda r: r.df.select("n_nationkey", "region.r_name")),
    "with_repeated": Registered("nation", "$select=n_nationkey&$with=region(),suppliers($select=s_suppkey),suppliers(s_acctbal>0)&$with=region($select=r_regionkey)", "select n_nationkey,r_name,s_suppkey from nation join region on n_regionkey=r_regionkey join supplier on s_nationkey=n_nationkey", lambda r: flat("suppliers", "s_suppkey", outer="n_nationkey r_name")(replace(r, df=r.df.withColumn("r_name", F.col("region.r_name"))))),
    "text_built": Registered("orders", build_url(parse_url("(o_totalprice>450000^o_totalprice<5000)&o_orderpriority!{'1-URGENT'}&!(o_orderstatus=F)&$select=o_orderstatus,sum(o_totalprice):total,count(*):n&$groupBy=o_orderstatus&$having=n>0&$sort=-n&$limit=3"), encode=True), "select o_orderstatus,round(sum(o_totalprice),2) total,count(*) n from orders where (o_totalprice>450000 or o_totalprice<5000) and o_orderpriority<>'1-URGENT' and o_orderstatus<>'F' group by 1 order by n desc limit 3", rounded("total")),
    "text_json": Registered("part", Query.from_json(parse_url("p_name~=/WIDGET$/i&p_size{1,2,3}&$sort=p_partkey&$limit=30&$select=p_partkey").to_json()), "select p_partkey from part where regexp_matches(p_name,'WIDGET$','i') and p_size in (1,2,3) order by p_partkey limit 30"),
    "filter_sql_text": Registered("orders", "$select=o_orderkey,o_orderstatus,o_totalprice,o_orderpriority", "select o_orderkey,o_orderstatus,o_totalprice,o_orderpriority from orders where (o_orderstatus in ('F','P') or o_totalprice>450000) and o_orderpriority<>'5-LOW'", lambda r: r.df.where(walk(parse_filter("(o_orderstatus{F,P}^o_totalprice>450000)&o_orderpriority!='5-LOW'"), ToSql("`")))),
    "insights": Registered("orders", "o_orderstatus=F&o_totalprice>1&$select=o_orderstatus,sum(o_totalprice):total,count(*)&$groupBy=o_orderstatus&$having=total>0&$sort=-total&$limit=1", "select * from (values ('o_orderstatus','$eq'),('o_orderstatus','$select'),('o_orderstatus','$groupBy'),('o_totalprice','$gt'),('o_totalprice','sum'),('total','$having'),('o_totalprice','$order'),('*','count')) t(field,used)", lambda r: r.df.sparkSession.createDataFrame([(f, u) for f, uses in get_insights(r.query).items() for u in uses], "field string, used string")),
    "with_agg": Registered("customer", "$with=orders($select=o_orderstatus,sum(o_totalprice):revenue&$groupBy=o_orderstatus&$having=revenue>1000000)", "select c_custkey,o_orderstatus,round(sum(o_totalprice),2) revenue from customer join orders on c_custkey=o_custkey group by 1,2 having sum(o_totalprice)>1000000", lambda r: flat("orders", "o_orderstatus", "revenue", outer="c_custkey")(r).withColumn("revenue", F.round("revenue", 2))),
    "with_nested": Registered("region", "$with=nations($with=suppliers(s_acctbal>5000))", "select r_name,n_name,s_suppkey from region join nation on n_regionkey=r_regionkey join supplier on s_nationkey=n_nationkey where s_acctbal>5000", lambda r: r.df.select("r_name", F.explode("nations").alias("n")).select("r_name", "n.n_name", F.explode("n.suppliers.s_suppkey").alias("s_suppkey"))),
    "flagship": Registered("orders", "o_orderdate>='1996-01-01'&o_orderstatus!=P&$select=sum(o_totalprice):total,count(*):n,o_orderpriority&$groupBy=o_orderpriority&$having=n>100&$sort=-total&$limit=10", "select o_orderpriority,round(sum(o_totalprice),2) total,count(*) n from orders where o_orderdate>=timestamp '1996-01-01' and o_orderstatus<>'P' group by 1 having count(*)>100 order by total desc limit 10", rounded("total")),
}


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    one = WORKLOAD[name]
    result = Engine(catalog(spark, sf_dir), one.null_mode).query(one.entity, one.query)
    return one.then(result) if one.then else result.df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, name=name: run(spark, sf_dir, name)) for name in WORKLOAD}


def oracle_sql() -> dict[str, str]:
    return {name: one.sql for name, one in WORKLOAD.items()}
