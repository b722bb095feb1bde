"""Queries over nested data: unions of JSON, ways up trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import json_union as unions
from dossier.operators import trees
from dossier.plans.registry import load, query

#: A fragment an order, in terms that both engines read alike.
FRAGMENT = """case o_orderkey % 8 when 0 then '{"a":{"x":' || o_orderkey || ',"y":{"z":"' || o_orderstatus || '"}}}' when 1 then '{"list":[' || (o_orderkey % 5) || ',null,"q"],"s":' || o_orderkey || '}'
 when 2 then '{"a":{"y":{"w":true},"n":null},"s":null}' when 3 then '{"a":5,"list":null}' when 4 then '{"list":["t"],"a":{"x":null}}' when 5 then '{"s":{"deep":{"er":' || o_orderkey || '}}}' when 6 then '{"s":[1],"a":{"y":7}}' else '{broken' end"""
_PATHS = {"a": "$.a", "x": "$.a.x", "y": "$.a.y", "z": "$.a.y.z", "w": "$.a.y.w", "list": "$.list", "s": "$.s", "er": "$.s.deep.er"}


@query(
    f"""with f as (select o_custkey as cv, o_orderkey as seq, {FRAGMENT} as body from orders), v as (select * from f where json_valid(body)),
 t as (select v.cv, v.seq, replace(n.fullkey, '"', '') as path, n.type as type, n.value as value from v, json_tree(v.body) n where n.type <> 'NULL' and n.fullkey <> '$' and not contains(n.fullkey, '[')),
 l as (select * from t where type <> 'OBJECT'),
 k as (select * from l where not exists (select 1 from t where t.cv = l.cv and t.seq > l.seq and ((t.path = l.path and not (t.type = 'ARRAY' and l.type = 'ARRAY')) or (t.type <> 'OBJECT' and starts_with(l.path, t.path || '.')) or starts_with(t.path, l.path || '.')))),
 i as (select cv, path, seq, type, case when type = 'ARRAY' then list_filter(json_extract(value, '$[*]')::varchar[], lambda x: x <> 'null') else [value::varchar] end as items from k),
 m as (select cv, path, case when any_value(type) = 'ARRAY' then '[' || coalesce(array_to_string(flatten(list(items order by seq)), ','), '') || ']' else any_value(items[1]) end as text from i group by cv, path)
 select o.cv as c_custkey, {", ".join(f"max(case when path = '{p}' then trim(text, chr(34)) end) as {c}" for c, p in _PATHS.items())} from (select distinct cv from f) o left join m on m.cv = o.cv group by o.cv"""
)
def json_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's JSON fragments as one: objects merged at any depth, arrays appended, nulls ignored, kinds that change."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.expr(FRAGMENT).alias("body"))
    merged = unions.union(o, "c_custkey", "o_orderkey", "body")
    at = {c: F.get_json_object("merged", p) for c, p in _PATHS.items()}
    # A path that leads to an object is none of the values.
    return merged.select("c_custkey", *(F.when(~v.startswith("{"), v).alias(c) for c, v in at.items()))


@query(
    """with recursive n as (select o_orderkey as id, case when o_orderkey % 7 = 0 then null when o_orderkey % 50 = 49 then -1 else o_orderkey - 1 - o_orderkey % 3 end as up, o_orderstatus = 'P' as halts from orders),
 k as (select n.id, p.id as parent, n.halts from n left join n p on p.id = n.up),
 r(id, here, steps) as (select id, id, 0 from k union all select r.id, k.parent, steps + 1 from r join k on k.id = r.here where k.parent is not null),
 d as (select r.id, max(steps) as steps from r group by r.id), h as (select r.id, min(steps) as steps from r join k on k.id = r.here where k.halts group by r.id)
 select d.id as o_orderkey, r.here as root, d.steps::bigint as depth, s.here as halt from d join r on r.id = d.id and r.steps = d.steps left join h on h.id = d.id left join r s on s.id = h.id and s.steps = h.steps"""
)
def tree_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every node of a forest of orders, and the first node on its way up that is of a kind."""
    k = F.col("o_orderkey")
    parent = F.when(k % 7 == 0, None).when(k % 50 == 49, F.lit(-1)).otherwise(k - 1 - k % 3)
    nodes = load(spark, sf_dir, "orders").select("o_orderkey", parent.alias("parent"), (F.col("o_orderstatus") == "P").alias("halts"))
    tops = trees.first_up(nodes, "o_orderkey").select("o_orderkey", F.col("found").alias("root"), F.col("steps").alias("depth"))
    halts = trees.first_up(nodes, "o_orderkey", stops=F.col("halts")).select("o_orderkey", F.col("found").alias("halt"))
    return tops.join(halts, "o_orderkey")
