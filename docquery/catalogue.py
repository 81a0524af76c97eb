"""One query for each operator over the driver's tables, with the DuckDB statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.operators.modifiers import modify
from docquery.operators.query import Collection, VectorIndex
from docquery.operators.text import TextIndex
from docquery.operators.vector import build_cells
from docquery.plans import pipelines as P
from docquery.plans.filters import parse_modifier
from docquery.sources.dynamic import typed
from docquery.sources.dynamic_pipeline import aggregate as dynamic_aggregate
from docquery.sources.store import merge_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "nation": "n_nationkey", "supplier": "s_suppkey"}


def collection(spark: SparkSession, sf_dir: str, table: str, **more: Any) -> Collection:
    return Collection(spark.read.parquet(f"{sf_dir}/{table}.parquet"), KEYS.get(table, "id"), table, **more)


def renamed(spark: SparkSession, sf_dir: str, table: str = "orders") -> Collection:
    """A table whose key is called id, as $lookup and $merge want it."""
    return Collection(spark.read.parquet(f"{sf_dir}/{table}.parquet").withColumnRenamed(KEYS[table], "id"), "id", table)


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def find(name: str, table: str, filter: Any, where: str, columns: str) -> None:  # noqa: A002
    names = columns.split(", ")
    query(name, f"SELECT {columns} FROM {table} WHERE {where}")(lambda s, d: collection(s, d, table).find(filter).rows().select(*names))


def pipeline(name: str, table: str, stages: list[dict], sql: str, key: str | None = None) -> None:
    query(name, sql)(lambda s, d: (renamed(s, d, table) if key else collection(s, d, table)).aggregate(stages).rows())


O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"  # noqa: E741
find("match_eq", "orders", {"o_orderstatus": "F"}, "o_orderstatus = 'F'", O)
find("match_ne", "orders", {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus <> 'F' OR o_orderstatus IS NULL", O)
find("match_range", "orders", {"o_totalprice": {"$gte": 1000, "$lt": 90000.5}}, "o_totalprice >= 1000 AND (o_totalprice < 90000.5 OR o_totalprice IS NULL)", O)
find("match_in", "orders", {"o_orderstatus": {"$in": ["F", "P", None, 5]}}, "o_orderstatus IN ('F', 'P') OR o_orderstatus IS NULL", O)
find("match_nin", "orders", {"o_orderstatus": {"$nin": ["F", "P"]}}, "coalesce(o_orderstatus, '') NOT IN ('F', 'P')", O)
find("match_and_or", "orders", {"$or": [{"o_orderstatus": "F", "o_custkey": {"$lte": 500}}, {"o_totalprice": {"$gt": 200000}}]}, "(o_orderstatus = 'F' AND (o_custkey <= 500 OR o_custkey IS NULL)) OR o_totalprice > 200000", O)
find("match_nor", "orders", {"$nor": [{"o_orderstatus": "F"}, {"o_custkey": {"$gt": 700}}]}, "NOT (o_orderstatus = 'F') AND NOT (o_custkey > 700)", O)
find("match_not", "orders", {"o_totalprice": {"$not": {"$gt": 50000}}}, "NOT coalesce(o_totalprice > 50000, false)", O)
find("match_all", "orders", {"o_orderstatus": {"$all": ["F"]}}, "o_orderstatus = 'F'", O)
find("match_regex", "part", {"p_name": {"$regex": "^[a-m].*e"}}, "regexp_matches(p_name, '^[a-m].*e')", "p_partkey, p_name")
find("match_regex_i", "customer", {"c_mktsegment": {"$regex": "^AUTO", "$options": "i"}}, "regexp_matches(c_mktsegment, '^AUTO', 'i')", "c_custkey, c_mktsegment")
find("match_regex_prefix", "customer", {"c_name": {"$regex": "^Customer#0000000[0-4]"}}, "regexp_matches(c_name, '^Customer#0000000[0-4]')", "c_custkey, c_name")
find("match_exists", "orders", {"o_orderpriority": {"$exists": True}, "nowhere": {"$exists": False}}, "o_orderpriority IS NOT NULL", O)
find("match_type", "orders", {"o_totalprice": {"$type": "number"}, "o_orderstatus": {"$type": 3}}, "o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL", O)
find("match_cross_type", "orders", {"o_orderstatus": {"$gt": 5}}, "o_orderstatus IS NOT NULL", O)
find("match_missing_lt", "orders", {"nowhere": {"$lt": 5}, "o_custkey": {"$lt": 100}}, "o_custkey < 100 OR o_custkey IS NULL", O)
find("match_date", "orders", {"o_orderdate": {"$gte": {"$date": "1996-01-01T00:00:00Z"}, "$lt": {"$date": "1997-01-01T00:00:00Z"}}}, "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'", O)
find("find_id", "orders", {"o_orderkey": 7}, "o_orderkey = 7", O)

query("match_array_elem", "SELECT vec_id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.4)) > 0")(lambda s, d: collection(s, d, "embeddings").find({"embedding": {"$gt": 0.4}}).rows().select("vec_id", "label"))
query("match_size", "SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64")(lambda s, d: collection(s, d, "embeddings").find({"embedding": {"$size": 64}}).rows().select("vec_id", "label"))
query("match_array_index", "SELECT vec_id, label FROM embeddings WHERE embedding[1] > 0")(lambda s, d: collection(s, d, "embeddings").find({"embedding.0": {"$gt": 0}}).rows().select("vec_id", "label"))
query("sort_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(lambda s, d: collection(s, d, "orders").find().sort("-o_totalprice").limit(25).rows().select("o_orderkey", "o_totalprice"))
query("sort_skip_limit", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_custkey DESC, o_orderkey LIMIT 40 OFFSET 30")(lambda s, d: collection(s, d, "orders").find().sort("o_orderstatus", "-o_custkey").offset(30).limit(40).rows().select("o_orderkey", "o_orderstatus"))
query("sort_array_key", "SELECT vec_id FROM embeddings ORDER BY list_min(embedding), vec_id LIMIT 20")(lambda s, d: collection(s, d, "embeddings").find().sort("embedding").limit(20).rows().select("vec_id"))
query("limit_natural", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")(lambda s, d: collection(s, d, "orders").find().offset(5).limit(10).rows().select("o_orderkey"))
pipeline("count_stage", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "SELECT count(*)::DOUBLE AS n FROM orders WHERE o_orderstatus = 'F'")

PRICING = [
    {"$match": {"l_shipdate": {"$lte": {"$date": "1998-09-02T00:00:00Z"}}}},
    {"$group": {"_id": {"rf": "$l_returnflag", "ls": "$l_linestatus"}, "qty": {"$sum": "$l_quantity"}, "base": {"$sum": "$l_extendedprice"}, "disc": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}, "charge": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}, {"$add": [1, "$l_tax"]}]}}, "avg_qty": {"$avg": "$l_quantity"}, "n": {"$count": {}}}},
    {"$project": {"rf": "$id.rf", "ls": "$id.ls", "sum_qty": {"$round": ["$qty", 2]}, "sum_base": {"$round": ["$base", 2]}, "sum_disc": {"$round": ["$disc", 2]}, "sum_charge": {"$round": ["$charge", 2]}, "avg_qty": {"$round": ["$avg_qty", 4]}, "n": 1}},
    {"$sort": {"rf": 1, "ls": 1}},
]
_RINT = lambda x, p: f"round_even(({x}) * 1e{p}, 0) / 1e{p}"
pipeline("pricing_summary", "lineitem", PRICING, f"""
SELECT l_returnflag AS rf, l_linestatus AS ls, {_RINT('sum(l_quantity)', 2)} AS sum_qty, {_RINT('sum(l_extendedprice)', 2)} AS sum_base,
  {_RINT('sum(l_extendedprice * (1 - l_discount))', 2)} AS sum_disc, {_RINT('sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))', 2)} AS sum_charge,
  {_RINT('avg(l_quantity)', 4)} AS avg_qty, count(*)::DOUBLE AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
pipeline("group_sum_avg", "orders", [{"$group": {"_id": "$o_orderstatus", "total": {"$sum": "$o_totalprice"}, "mean": {"$avg": "$o_totalprice"}, "n": {"$count": {}}, "none": {"$sum": "$o_orderpriority"}}}, {"$project": {"id": 1, "total": {"$round": ["$total", 2]}, "mean": {"$round": ["$mean", 4]}, "n": 1, "none": 1}}],
         f"SELECT o_orderstatus AS id, {_RINT('sum(o_totalprice)', 2)} AS total, {_RINT('avg(o_totalprice)', 4)} AS mean, count(*)::DOUBLE AS n, 0.0::DOUBLE AS \"none\" FROM orders GROUP BY 1")
pipeline("group_compound", "orders", [{"$group": {"_id": {"s": "$o_orderstatus", "p": "$o_orderpriority"}, "n": {"$count": {}}}}, {"$project": {"s": "$id.s", "p": "$id.p", "n": 1}}], "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2")
pipeline("group_minmax", "customer", [{"$group": {"_id": "$c_mktsegment", "least": {"$min": "$c_acctbal"}, "most": {"$max": "$c_acctbal"}, "name": {"$max": "$c_name"}}}], "SELECT c_mktsegment AS id, min(c_acctbal) AS least, max(c_acctbal) AS most, max(c_name) AS name FROM customer GROUP BY 1")
pipeline("group_first_last", "orders", [{"$sort": {"o_totalprice": -1}}, {"$group": {"_id": "$o_orderpriority", "dearest": {"$first": "$o_orderkey"}, "cheapest": {"$last": "$o_orderkey"}}}], "SELECT o_orderpriority AS id, arg_min(o_orderkey, (-o_totalprice, o_orderkey))::DOUBLE AS dearest, arg_max(o_orderkey, (-o_totalprice, o_orderkey))::DOUBLE AS cheapest FROM orders GROUP BY 1")
pipeline("group_push", "nation", [{"$sort": {"n_name": -1}}, {"$group": {"_id": "$n_regionkey", "names": {"$push": "$n_name"}}}], "SELECT n_regionkey::DOUBLE AS id, list(n_name ORDER BY n_name DESC, n_nationkey) AS names FROM nation GROUP BY n_regionkey")
pipeline("group_addtoset", "customer", [{"$sort": {"c_mktsegment": 1}}, {"$group": {"_id": "$c_nationkey", "segments": {"$addToSet": "$c_mktsegment"}}}], "SELECT c_nationkey::DOUBLE AS id, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer GROUP BY c_nationkey")
pipeline("distinct_values", "orders", [{"$group": {"_id": "$o_orderpriority"}}], "SELECT DISTINCT o_orderpriority AS id FROM orders")
pipeline("project_arith", "orders", [{"$project": {"o_orderkey": 1, "a": {"$add": ["$o_totalprice", "$o_custkey", 1]}, "s": {"$subtract": ["$o_totalprice", "$o_custkey"]}, "d": {"$divide": ["$o_custkey", {"$subtract": ["$o_custkey", 7]}]}, "m": {"$multiply": ["$o_custkey", 1.5]}, "b": {"$abs": {"$subtract": [500, "$o_custkey"]}}}}],
         "SELECT o_orderkey, o_totalprice + o_custkey + 1 AS a, o_totalprice - o_custkey AS s, CASE WHEN o_custkey <> 7 THEN o_custkey::DOUBLE / (o_custkey - 7) END AS d, o_custkey * 1.5::DOUBLE AS m, abs(500 - o_custkey)::DOUBLE AS b FROM orders")
pipeline("project_round", "orders", [{"$project": {"o_orderkey": 1, "r": {"$round": "$o_totalprice"}, "r1": {"$round": ["$o_totalprice", 1]}, "rn": {"$round": ["$o_totalprice", -2]}}}], f"SELECT o_orderkey, round_even(o_totalprice, 0) AS r, {_RINT('o_totalprice', 1)} AS r1, round_even(o_totalprice / 100, 0) * 100 AS rn FROM orders")
pipeline("project_cond", "orders", [{"$project": {"o_orderkey": 1, "size": {"$cond": [{"$gte": ["$o_totalprice", 100000]}, "big", "small"]}}}], "SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 'big' ELSE 'small' END AS size FROM orders")
pipeline("project_switch", "orders", [{"$project": {"o_orderkey": 1, "k": {"$switch": {"branches": [{"case": {"$eq": ["$o_orderstatus", "F"]}, "then": 1}, {"case": {"$lt": ["$o_totalprice", 50000]}, "then": 2}], "default": 3}}}}], "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE WHEN o_totalprice < 50000 THEN 2.0 ELSE 3.0 END AS k FROM orders")
pipeline("project_ifnull", "orders", [{"$project": {"o_orderkey": 1, "k": {"$ifNull": ["$nowhere", {"$divide": ["$o_custkey", 0]}, "$o_custkey"]}}}], "SELECT o_orderkey, o_custkey::DOUBLE AS k FROM orders")
pipeline("project_cmp", "orders", [{"$project": {"o_orderkey": 1, "c": {"$cmp": ["$o_custkey", 700]}, "x": {"$gt": ["$o_orderstatus", "$o_custkey"]}, "n": {"$lt": ["$nowhere", "$o_custkey"]}, "e": {"$ne": ["$o_custkey", 5]}}}], "SELECT o_orderkey, sign(o_custkey - 700)::DOUBLE AS c, true AS x, true AS n, o_custkey <> 5 AS e FROM orders")
pipeline("project_concat", "part", [{"$project": {"p_partkey": 1, "label": {"$concat": ["$p_brand", " / ", "$p_type"]}, "bad": {"$concat": ["$p_brand", "$p_size"]}}}], "SELECT p_partkey, p_brand || ' / ' || p_type AS label, NULL::VARCHAR AS bad FROM part")
pipeline("project_replace", "part", [{"$project": {"p_partkey": 1, "one": {"$replaceOne": {"input": "$p_name", "find": "e", "replacement": "E"}}, "all": {"$replaceAll": {"input": "$p_name", "find": "e", "replacement": "__"}}, "pre": {"$replaceAll": {"input": "$p_name", "find": "", "replacement": ">"}}}}],
         "SELECT p_partkey, regexp_replace(p_name, 'e', 'E') AS one, replace(p_name, 'e', '__') AS \"all\", '>' || p_name AS pre FROM part")
pipeline("project_split", "part", [{"$project": {"p_partkey": 1, "words": {"$split": ["$p_name", " "]}}}], "SELECT p_partkey, string_split(p_name, ' ') AS words FROM part")
pipeline("project_trim", "customer", [{"$project": {"c_custkey": 1, "t": {"$trim": {"input": {"$concat": [" \t", "$c_name", "\n "]}}}, "l": {"$ltrim": {"input": "$c_name", "chars": "Cus"}}, "r": {"$rtrim": {"input": "$c_name", "chars": "0123456789"}}}}], "SELECT c_custkey, c_name AS t, ltrim(c_name, 'Cus') AS l, rtrim(c_name, '0123456789') AS r FROM customer")
pipeline("project_date", "orders", [{"$project": {"o_orderkey": 1, "y": {"$year": "$o_orderdate"}, "w": {"$week": "$o_orderdate"}, "a": {"$dateAdd": {"startDate": "$o_orderdate", "unit": "month", "amount": 1}}, "h": {"$dateAdd": {"startDate": "$o_orderdate", "unit": "hour", "amount": 30}}, "q": {"$dateTrunc": {"date": "$o_orderdate", "unit": "quarter"}}}}],
         "SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, floor((dayofyear(o_orderdate) - 1 + 7 - dayofweek(o_orderdate)) / 7)::DOUBLE AS w, o_orderdate + INTERVAL 1 MONTH AS a, o_orderdate + INTERVAL 30 HOUR AS h, date_trunc('quarter', o_orderdate)::TIMESTAMP AS q FROM orders")
pipeline("date_diff", "events", [{"$project": {"event_id": 1, "d": {"$dateDiff": {"startDate": {"$literal": {"$date": "2024-01-06T12:00:00Z"}}, "endDate": "$ts", "unit": "day"}}, "w": {"$dateDiff": {"startDate": {"$literal": {"$date": "2024-01-06T12:00:00Z"}}, "endDate": "$ts", "unit": "week"}}, "mi": {"$dateDiff": {"startDate": {"$literal": {"$date": "2024-01-06T12:00:00Z"}}, "endDate": "$ts", "unit": "minute"}}, "mo": {"$dateDiff": {"startDate": {"$literal": {"$date": "2024-01-06T12:00:00Z"}}, "endDate": "$ts", "unit": "month"}}}}],
         "SELECT event_id, date_diff('day', TIMESTAMP '2024-01-06 12:00', ts)::DOUBLE AS d, (floor((date_diff('day', DATE '1970-01-01', ts::DATE) - 3) / 7) - floor((date_diff('day', DATE '1970-01-01', DATE '2024-01-06') - 3) / 7))::DOUBLE AS w, date_diff('minute', TIMESTAMP '2024-01-06 12:00', ts)::DOUBLE AS mi, date_diff('month', TIMESTAMP '2024-01-06 12:00', ts)::DOUBLE AS mo FROM events")
pipeline("date_trunc_bin", "events", [{"$group": {"_id": {"$dateTrunc": {"date": "$ts", "unit": "hour", "binSize": 6}}, "n": {"$count": {}}}}], "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01')::TIMESTAMP AS id, count(*)::DOUBLE AS n FROM events GROUP BY 1")
pipeline("date_zone", "events", [{"$group": {"_id": {"$dateTrunc": {"date": "$ts", "unit": "day", "timezone": "+05:30"}}, "n": {"$count": {}}}}], "SELECT date_trunc('day', ts + INTERVAL 330 MINUTE)::TIMESTAMP - INTERVAL 330 MINUTE AS id, count(*)::DOUBLE AS n FROM events GROUP BY 1")
pipeline("add_fields", "orders", [{"$addFields": {"double": {"$multiply": ["$o_totalprice", 2]}, "o_custkey": {"$add": ["$o_custkey", 1]}}}, {"$project": {"o_orderkey": 1, "double": 1, "o_custkey": 1}}], "SELECT o_orderkey, o_totalprice * 2 AS double, (o_custkey + 1)::DOUBLE AS o_custkey FROM orders")
pipeline("unwind_split", "part", [{"$project": {"w": {"$split": ["$p_name", " "]}}}, {"$unwind": "$w"}, {"$group": {"_id": "$w", "n": {"$count": {}}}}], "SELECT w AS id, count(*)::DOUBLE AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
pipeline("unwind_preserve", "part", [{"$project": {"p_partkey": 1, "w": {"$cond": [{"$gt": ["$p_size", 25]}, {"$split": ["$p_name", " "]}, {"$ifNull": ["$nowhere", "$nothing"]}]}}}, {"$unwind": {"path": "$w", "preserveNullAndEmptyArrays": True}}], "SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN string_split(p_name, ' ') ELSE [NULL] END) AS w FROM part")
pipeline("expr_field_field", "orders", [{"$match": {"$expr": {"$gt": ["$o_custkey", {"$divide": ["$o_orderkey", 10]}]}}}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders WHERE o_custkey > o_orderkey / 10.0")
pipeline("lookup_self", "orders", [{"$lookup": {"localField": "o_custkey", "as": "other"}}, {"$project": {"id": 1, "other": "$other.id"}}], "SELECT a.o_orderkey AS id, CASE WHEN b.o_orderkey IS NULL THEN [] ELSE [b.o_orderkey] END AS other FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_custkey", "id")
pipeline("lookup_array", "nation", [{"$addFields": {"refs": ["$n_regionkey", 3, "$n_regionkey", 99]}}, {"$lookup": {"localField": "refs", "as": "other"}}, {"$project": {"id": 1, "names": "$other.n_name"}}],
         "SELECT a.n_nationkey AS id, [b.n_name] || CASE WHEN a.n_regionkey <> 3 THEN [c.n_name] ELSE [] END AS names FROM nation a JOIN nation b ON b.n_nationkey = a.n_regionkey JOIN nation c ON c.n_nationkey = 3", "id")
pipeline("facet_dashboard", "orders", [{"$facet": {"total": [{"$count": "n"}], "top": [{"$sort": {"o_totalprice": -1}}, {"$limit": 3}, {"$project": {"o_orderkey": 1}}], "none": [{"$match": {"o_orderstatus": "nothing"}}, {"$count": "n"}]}}, {"$project": {"total": "$total.n", "top": "$top.o_orderkey", "none": "$none.n"}}],
         "SELECT [count(*)::DOUBLE] AS total, (SELECT list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)) AS top, [0.0::DOUBLE] AS \"none\" FROM orders")


TEXT = {"text": {"body": TextIndex(("text",))}}


def text(name: str, clause: dict, sql: str | None = None) -> None:
    query(name, sql)(lambda s, d: collection(s, d, "documents", **TEXT).find({"$text": clause}).rows().select("doc_id", F.round("_score", 6).alias("score")))


text("text_or", {"$search": "nation worthless"})
text("text_and", {"$search": "the of", "$defaultOperator": "and"})
text("text_phrase", {"$search": '"of the"'})
text("text_require_exclude", {"$search": "the", "$require": "of", "$exclude": ["und", "idiot"]})
text("text_prefix", {"$search": "worth*"})


def knn(name: str, metric: str, distance: str, where: str = "true", residual: dict | None = None) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        c = collection(s, d, "embeddings")
        vector = [float(x) for x in c.find_id(7)["embedding"]]  # the query vector is one stored row
        c = Collection(c.df, c.pk, c.name, {}, {"v": VectorIndex("embedding", metric)})
        rows = c.find({"embedding": {"$knn": {"$query": vector, "$k": 10}}, **(residual or {})}).rows()
        return rows.select("vec_id", F.round("_distance", 4).alias("distance"))

    query(name, f"WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7) SELECT vec_id, round({distance}, 4)::DOUBLE + 0.0 AS distance FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, v::DOUBLE[] AS v FROM embeddings, q) WHERE {where} ORDER BY {distance}, vec_id LIMIT 10")(run)


knn("knn_cosine", "cosine", "list_cosine_distance(e, v)")
knn("knn_l2", "l2", "list_distance(e, v)")
knn("knn_dot", "dot", "list_negative_inner_product(e, v)")
knn("knn_filtered", "cosine", "list_cosine_distance(e, v)", "label >= 3", {"label": {"$gte": 3}})


@query("knn_ivf")
def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate by design: 16 cells, 8 probed, exact distances within them."""
    c = collection(spark, sf_dir, "embeddings")
    vector = [float(x) for x in c.find_id(7)["embedding"]]
    cells, centers = build_cells(c.df, "embedding", 16)
    c = Collection(c.df, c.pk, c.name, {}, {"v": VectorIndex("embedding", "cosine", tuple(centers), cells, 8)})
    return c.find({"embedding": {"$knn": {"$query": vector, "$k": 10}}}).rows().select("vec_id", F.round("_distance", 4).alias("distance"))


@query("update_set_inc", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 5 ELSE o_custkey END AS o_custkey FROM orders")
def update_set_inc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = renamed(spark, sf_dir)
    hit = c.find({"o_orderstatus": "F"}).rows()
    new = modify(hit, parse_modifier({"$inc": {"o_custkey": 5}, "$set": {"o_orderstatus": "done"}})).drop("__modified")
    return new.unionByName(c.find({"o_orderstatus": {"$ne": "F"}}).rows()).select("id", "o_orderstatus", "o_custkey")


@query("update_arrays", "SELECT p_partkey, (string_split(p_name, ' ') || ['x'])[2:] AS words FROM part")
def update_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collection(spark, sf_dir, "part").aggregate([{"$project": {"p_partkey": 1, "words": {"$split": ["$p_name", " "]}}}]).rows()
    return modify(rows, parse_modifier({"$push": {"words": "x"}, "$pop": {"words": -1}, "$addToSet": {"words": "x"}, "$pull": {"words": "nothing"}}, "p_partkey")).drop("__modified")


@query("merge_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT o_orderkey + 1000000000000, o_totalprice * 2 FROM orders WHERE o_orderstatus = 'F'")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubled prices of finished orders, under their own keys and under new ones."""
    c = renamed(spark, sf_dir)
    new = c.aggregate([{"$match": {"o_orderstatus": "F"}}, {"$project": {"id": 1, "o_totalprice": {"$multiply": ["$o_totalprice", 2]}}}]).rows()
    new = new.unionByName(new.withColumn("id", F.col("id") + 1_000_000_000_000))
    return merge_rows(c.df.select("id", "o_totalprice"), new, P.Merge("target"))[0]


def dynamic(name: str, table: str, doc: str, stages: list[dict], schema: str, sql: str) -> None:
    """A pipeline over documents of mixed types, made of a table's rows by a SQL expression."""

    def run(s: SparkSession, d: str) -> DataFrame:
        docs = s.read.parquet(f"{d}/{table}.parquet").select(F.expr(doc).alias("doc"))
        return typed(dynamic_aggregate(docs, stages), schema)

    query(name, sql)(run)


_MIXED = """concat('{"id": ', event_id, ', "k": ', CASE WHEN event_id % 2 = 0 THEN cast(user_id % 3 AS string) ELSE concat('"s', user_id % 3, '"') END, ', "u": ', CASE WHEN event_id % 5 = 0 THEN '"none"' ELSE cast(user_id AS string) END, '}')"""
dynamic("dyn_group_mixed", "events", _MIXED, [{"$group": {"_id": "$k", "n": {"$count": {}}, "total": {"$sum": "$u"}, "least": {"$min": "$u"}, "most": {"$max": "$u"}, "first": {"$first": "$id"}}}], "id string, n double, total double, least string, most string, first long",
        "SELECT CASE WHEN event_id % 2 = 0 THEN (user_id % 3)::VARCHAR ELSE 's' || (user_id % 3) END AS id, count(*)::DOUBLE AS n, sum(CASE WHEN event_id % 5 <> 0 THEN user_id ELSE 0 END)::DOUBLE AS total, min(CASE WHEN event_id % 5 <> 0 THEN user_id END)::VARCHAR AS least, CASE WHEN count(*) FILTER (event_id % 5 = 0) > 0 THEN 'none' ELSE max(user_id)::VARCHAR END AS most, min(event_id) AS first FROM events GROUP BY 1")
dynamic("dyn_unwind", "part", """concat('{"id": ', p_partkey, ', "w": ', CASE WHEN p_size > 25 THEN to_json(split(p_name, ' ')) ELSE to_json(array(p_name)) END, '}')""", [{"$unwind": "$w"}, {"$match": {"w": {"$regex": "^[[:lower:]]"}}}, {"$group": {"_id": "$w", "n": {"$count": {}}, "sizes": {"$addToSet": {"$cond": [{"$gt": ["$id", 100]}, "late", 1]}}}}, {"$project": {"id": 1, "n": 1}}], "id string, n double",
        "SELECT w AS id, count(*)::DOUBLE AS n FROM (SELECT unnest(CASE WHEN p_size > 25 THEN string_split(p_name, ' ') ELSE [p_name] END) AS w FROM part) WHERE regexp_matches(w, '^[[:lower:]]') GROUP BY 1")
dynamic("dyn_sort_mixed", "orders", """concat('{"id": ', o_orderkey, ', "v": ', CASE WHEN o_orderkey % 3 = 0 THEN concat('"', o_orderpriority, '"') ELSE cast(o_custkey AS string) END, '}')""", [{"$sort": {"v": -1}}, {"$limit": 6000}, {"$group": {"_id": "$v", "n": {"$count": {}}}}], "id string, n double",
        "SELECT v AS id, count(*)::DOUBLE AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_custkey::VARCHAR END AS v FROM orders ORDER BY o_orderkey % 3 = 0 DESC, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END DESC, o_custkey DESC, o_orderkey LIMIT 6000) GROUP BY 1")
pipeline("lookup_after_group", "nation", [{"$group": {"_id": "$n_regionkey"}}, {"$project": {"refs": [1, 2, 1, 77]}}, {"$lookup": {"localField": "refs", "as": "other"}}, {"$project": {"names": "$other.n_name"}}], "SELECT [(SELECT n_name FROM nation WHERE n_nationkey = 1), (SELECT n_name FROM nation WHERE n_nationkey = 2)] AS names FROM (SELECT DISTINCT n_regionkey FROM nation)", "id")
find("match_regex_posix", "part", {"p_name": {"$regex": r"^[[:lower:]]+\x20\Q\E[^[:upper:]]*\pL\z"}}, r"regexp_matches(p_name, '^[[:lower:]]+\x20[^[:upper:]]*\pL\z')", "p_partkey, p_name")
