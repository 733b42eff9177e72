"""Registered queries for the engine's own operators, each with DuckDB SQL for the same rows.

They run the operators over the star-schema tables: orders, parts, suppliers and customers stand for product masters,
line items for holdings, regions and nations for companies and their subsidiaries, documents and embeddings for chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as t
from lattica.functions import values as v
from lattica.operators import evidence, federate, joins, vector, views
from lattica.operators.graph import Edge, Graph, Output, Plan
from lattica.operators.ontology import Ontology
from lattica.plans.catalog import Attribute, Catalog, Domain, Enrichment, Guard, OutputView, SalePolicy, Subtype
from lattica.plans.compile import SORTED, TESTED, Compiler
from lattica.session import shared_dir, table
from lattica.sources.turtle import parse

FLAGSHIP = "ordinal_sort_topk"
PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")  # worst to best
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


def _attributes(*items: Attribute) -> dict[str, Attribute]:
    return {a.name: a for a in items}


CATALOG = Catalog(
    [
        Domain(
            "orders", "orders", "o_orderkey", "o_orderstatus", ("o_orderstatus", "o_orderkey"),
            _attributes(
                Attribute("priority", "o_orderpriority", "ordinal", PRIORITIES), Attribute("price", "o_totalprice", "numeric"), Attribute("status", "o_orderstatus", "categorical", ("F", "O", "P")),
                Attribute("customer", "c_name", "text", join="customer", organisation=True), Attribute("segment", "c_mktsegment", "categorical", SEGMENTS, join="customer"),
            ),
            {"total": "price"}, {"customer": Enrichment("customer", "c_custkey", "o_custkey")},
        ),
        Domain(
            "parts", "part", "p_partkey", "p_name", ("p_name", "p_brand"),
            _attributes(
                Attribute("name", "p_name"), Attribute("brand", "p_brand"), Attribute("type", "p_type", "categorical", ("ECONOMY", "PROMO", "MEDIUM", "STANDARD", "SMALL", "LARGE")),
                Attribute("size", "p_size", "numeric"), Attribute("price", "p_retailprice", "numeric", unit="percent"),
            ),
            subtypes={"cheap": Subtype("p_retailprice", "<", "1000"), "ring": Subtype("p_name", "contains", "ring"), "promo": Subtype("p_type", "eq", "PROMO")},
            sale=SalePolicy("promoted parts are on sale", "p_type", "PROMO"), guard=Guard("p_type", "ECONOMY", "LARGE"),
        ),
        Domain("lines", "lineitem", "l_orderkey", "l_linestatus", ("l_linestatus",), _attributes(Attribute("returned", "l_returnflag", "flag", true="R"), Attribute("quantity", "l_quantity", "numeric"))),
        Domain("customers", "customer", "c_custkey", "c_name", ("c_name",), _attributes(Attribute("name", "c_name", organisation=True), Attribute("balance", "c_acctbal", "numeric"), Attribute("segment", "c_mktsegment", "categorical", SEGMENTS))),
        Domain("suppliers", "supplier", "s_suppkey", "s_name", ("s_name",), _attributes(Attribute("name", "s_name", organisation=True), Attribute("balance", "s_acctbal", "numeric"))),
    ]
)


def _compiler(spark: SparkSession, d: str, *names: str) -> Compiler:
    return Compiler(CATALOG, {n: table(spark, d, n) for n in {"orders", "part", "lineitem", "customer", "supplier", *names}})


def _named(spark: SparkSession, d: str, request: dict, **columns: str) -> DataFrame:
    rows = _compiler(spark, d).compile(request).rows
    return rows.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


# --- requests over one domain


@query("""
SELECT o_orderkey AS code, o_orderpriority AS priority, o_totalprice AS price FROM orders
WHERE o_orderpriority IN ('3-MEDIUM', '2-HIGH', '1-URGENT') AND o_totalprice IS NOT NULL ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20
""")
def ordinal_sort_topk(spark, d):
    request = {"domain": "orders", "conditions": [{"attribute": "priority", "operator": "gte", "value": "3-MEDIUM"}], "sort": {"attribute": "price", "order": "desc", "limit": "top 20"}}
    return _named(spark, d, request, code="code", priority=TESTED.format("priority"), price=SORTED.format("price"))


def _priority(operator, value, upper=None):
    return lambda spark, d: _named(spark, d, {"domain": "orders", "conditions": [{"attribute": "priority", "operator": operator, "value": value, "value_2": upper}]}, code="code", priority=TESTED.format("priority"))


for _name, _args, _labels in (
    ("ordinal_gte", ("gte", "3-MEDIUM"), "'3-MEDIUM','2-HIGH','1-URGENT'"), ("ordinal_gt", ("gt", "3-MEDIUM"), "'2-HIGH','1-URGENT'"), ("ordinal_lte", ("lte", "4-not specified"), "'5-LOW','4-NOT SPECIFIED'"),
    ("ordinal_ne", ("ne", "5-LOW"), "'4-NOT SPECIFIED','3-MEDIUM','2-HIGH','1-URGENT'"), ("ordinal_between", ("between", "4-NOT SPECIFIED", "2-HIGH"), "'4-NOT SPECIFIED','3-MEDIUM','2-HIGH'"), ("ordinal_empty", ("gt", "1-URGENT"), "NULL"),
):
    QUERIES[_name] = _priority(*_args)
    ORACLE_SQL[_name] = f"SELECT o_orderkey AS code, o_orderpriority AS priority FROM orders WHERE o_orderpriority IN ({_labels})"


@query("""
SELECT o_orderkey AS code, o_orderpriority AS priority, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4 ELSE 5 END AS place
FROM orders ORDER BY place DESC, o_orderkey LIMIT 20
""")
def ordinal_sort(spark, d):
    rows = _named(spark, d, {"domain": "orders", "sort": {"attribute": "priority", "order": "desc", "limit": 20}}, code="code", priority=SORTED.format("priority"))
    return rows.withColumn("place", v.rank_on(F.col("priority"), list(PRIORITIES)).cast("int"))


@query("""
SELECT o_orderkey AS code, c_name AS customer, c_mktsegment AS segment, o_totalprice AS price FROM orders LEFT JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 400000
""")
def enrichment_join(spark, d):
    request = {"domain": "orders", "fields": ["customer"], "conditions": [{"attribute": "segment", "operator": "eq", "value": " building "}, {"attribute": "total", "operator": "gt", "value": "400,000"}]}
    return _named(spark, d, request, code="code", customer="customer", segment=TESTED.format("segment"), price=TESTED.format("total"))


@query("""
SELECT o_orderkey AS code, o_orderstatus AS status FROM orders WHERE (o_orderstatus <> 'F') AND (o_orderpriority IN ('1-URGENT') OR o_totalprice BETWEEN 100000 AND 120000)
""")
def any_group(spark, d):
    conditions = [
        {"attribute": "status", "operator": "ne", "value": "f"}, {"attribute": "priority", "operator": "eq", "value": "1-URGENT", "group": "g"},
        {"attribute": "price", "operator": "between", "value": "100000", "value_2": "120000", "group": "g"}, {"attribute": "size", "operator": "eq", "value": "1", "domain": "parts"},
    ]
    return _named(spark, d, {"domain": "orders", "conditions": conditions}, code="code", status="name")


@query("SELECT l_orderkey AS code, l_returnflag AS flag, l_quantity AS quantity FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity >= 45")
def flag_ne(spark, d):
    return _named(spark, d, {"domain": "lines", "conditions": [{"attribute": "returned", "operator": "eq", "value": "불가"}, {"attribute": "quantity", "operator": "gte", "value": "45"}]}, code="code", flag=TESTED.format("returned"), quantity=TESTED.format("quantity"))


@query("SELECT c_custkey AS code, c_name AS name FROM customer WHERE replace(lower(replace(c_name, ' ', '')), '(주)', '') = 'customer#000000005'")
def organisation_eq(spark, d):
    return _named(spark, d, {"domain": "customers", "conditions": [{"attribute": "name", "operator": "eq", "value": "(주) Customer#000000005"}]}, code="code", name="name")


@query("SELECT p_partkey AS code, p_name AS name FROM part WHERE p_type = 'ECONOMY' AND position('dwidg' IN lower(replace(p_name, ' ', ''))) > 0")
def contains_literal(spark, d):
    return _named(spark, d, {"domain": "parts", "conditions": [{"attribute": "name", "operator": "contains", "value": "d Widg"}]}, code="code", name="name")


@query("SELECT p_partkey AS code, p_brand AS brand, p_size AS size FROM part WHERE p_type = 'LARGE' AND p_brand IN ('Brand#1', 'Brand#2') AND p_size BETWEEN 10 AND 20")
def in_list_and_guard(spark, d):
    request = {"domain": "parts", "conditions": [{"attribute": "brand", "operator": "in", "value": "Brand#1, Brand#2"}, {"attribute": "size", "operator": "between", "value": "10", "value_2": "20"}, {"attribute": "type", "operator": "eq", "value": "large"}]}
    return _named(spark, d, request, code="code", brand=TESTED.format("brand"), size=TESTED.format("size"))


@query("SELECT p_partkey AS code, p_retailprice AS price, p_type AS type FROM part WHERE p_retailprice < 1000 AND p_type = 'PROMO' AND position('ring' IN p_name) > 0")
def subtype_and_sale(spark, d):
    return _named(spark, d, {"domain": "parts", "subtypes": ["cheap", "promo", "ring"], "on_sale": True}, code="code", price=TESTED.format("price"), type=TESTED.format("type"))


@query("SELECT p_partkey AS code, p_name AS name FROM part WHERE p_type = 'ECONOMY' AND (lower(replace(p_name, ' ', '')) = 'redwidget' OR lower(replace(p_brand, ' ', '')) = 'redwidget')")
def identity_exact(spark, d):
    return _named(spark, d, {"domain": "parts", "entity": "Red  Widget"}, code="code", name="name")


@query("""
SELECT p_partkey AS code, p_name AS name FROM part WHERE p_type = 'ECONOMY' AND (
  (lower(replace(p_name, ' ', '')) = 'widg' OR lower(replace(p_brand, ' ', '')) = 'widg')
  OR (NOT EXISTS (SELECT 1 FROM part x WHERE lower(replace(x.p_name, ' ', '')) = 'widg' OR lower(replace(x.p_brand, ' ', '')) = 'widg') AND position('widg' IN lower(replace(p_name, ' ', ''))) > 0))
""")
def identity_fallback(spark, d):
    return _named(spark, d, {"domain": "parts", "entity": "widg"}, code="code", name="name")


# --- scalar functions


@query(r"""
SELECT doc_id, CASE WHEN regexp_full_match(replace(trim(x), ',', ''), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(CAST(replace(trim(x), ',', '') AS DECIMAL(28, 4)) AS DOUBLE) END AS number
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' 1,234.5 ' WHEN 1 THEN source WHEN 2 THEN '.5' WHEN 3 THEN CAST(n_chars AS VARCHAR) ELSE '12a' END AS x FROM documents)
""")
def guarded_numeric(spark, d):
    docs = table(spark, d, "documents")
    x = F.when(F.col("doc_id") % 5 == 0, " 1,234.5 ").when(F.col("doc_id") % 5 == 1, F.col("source")).when(F.col("doc_id") % 5 == 2, ".5").when(F.col("doc_id") % 5 == 3, F.col("n_chars").cast("string")).otherwise("12a")
    return docs.select("doc_id", v.guarded_number(x, "decimal(28,4)").cast("double").alias("number"))


@query(r"""
SELECT p_partkey, lower(replace(p_name, ' ', '')) AS squeezed, regexp_replace(lower(p_name), '[\s_\-]+', '', 'g') AS key, upper(regexp_replace(p_brand, '[\s\[\]()·\-]', '', 'g')) AS provenance,
  CASE WHEN p_size % 2 = 0 THEN 'A' || p_size ELSE NULL END AS share_class, p_name AS label
FROM part
""")
def text_functions(spark, d):
    p = table(spark, d, "part")
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" class A"), F.col("p_size"))).otherwise(""))
    return p.select("p_partkey", t.squeezed(F.col("p_name")).alias("squeezed"), t.key_of(F.col("p_name")).alias("key"), t.provenance_key(F.col("p_brand")).alias("provenance"), t.share_class(name).alias("share_class"), t.public_label(F.concat("p_name", F.lit(" (p_name)"))).alias("label"))


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS stored, NULLIF(o_orderkey % 3, 0) AS nonzero FROM orders
""")
def stored_dates(spark, d):
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, "99991231").when(F.col("o_orderkey") % 7 == 1, "20240231").otherwise(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".0")))
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), v.stored_day(text).alias("stored"), v.zero_as_null(F.col("o_orderkey") % 3).alias("nonzero"))


# --- joins


@query("""
SELECT user_id, max(CASE WHEN event_type = 'purchase' AND value > 0 THEN value END) AS purchase, max(CASE WHEN event_type = 'view' AND value > 0 THEN value END) AS view FROM events
WHERE event_type IN ('purchase', 'view') GROUP BY user_id
""")
def eav_pivot(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("product_id"), F.col("event_type").alias("metric_code"), "value", (F.col("value") > 0).alias("is_available"))
    return joins.metric_columns(e, ["purchase", "view"]).withColumnRenamed("product_id", "user_id")


@query("""
SELECT c.c_custkey, m.value AS purchase FROM customer c LEFT JOIN (SELECT user_id, CASE WHEN value > 5 THEN value END AS value FROM events WHERE event_type = 'signup') m ON m.user_id = c.c_custkey
""")
def metric_join(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("product_id"), F.col("event_type").alias("metric_code"), "value", (F.col("value") > 5).alias("is_available"))
    customers = table(spark, d, "customer").select("c_custkey")
    links = customers.select(F.col("c_custkey").alias("product_id"), F.col("c_custkey").alias("key"))
    metrics = joins.metric_table(links, e, "signup", "key", "purchase")
    return customers.join(metrics, customers["c_custkey"] == metrics["key"], "left").select("c_custkey", "purchase")


@query("""
SELECT a.doc_id, b.doc_id AS other FROM (SELECT doc_id, source, n_chars, CASE WHEN n_chars > 2000 THEN lang END AS lang FROM documents) a
JOIN (SELECT doc_id, source, n_chars, CASE WHEN n_chars > 2000 THEN lang END AS lang FROM documents) b ON a.source = b.source AND a.n_chars = b.n_chars AND a.lang IS NOT DISTINCT FROM b.lang
""")
def nullsafe_join(spark, d):
    a = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.when(F.col("n_chars") > 2000, F.col("lang")).alias("lang"))
    return joins.keyed(a, a.withColumnRenamed("doc_id", "other"), ["source", "n_chars"], ["lang"]).select("doc_id", "other")


@query("""
SELECT n_nationkey, coalesce((SELECT list_sort(list(DISTINCT s_suppkey)) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000), []) AS suppliers FROM nation
""")
def array_nest(spark, d):
    s = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return joins.nested_sets(table(spark, d, "nation").select("n_nationkey"), s, "n_nationkey", "s_suppkey", "suppliers")


@query("""
WITH wanted(wanted) AS (VALUES ('Red widget'), ('Brand#5'), ('Supplier#000000001')), found AS (
  SELECT w.wanted, 'parts' AS domain, CAST(p_partkey AS VARCHAR) AS code, p_name AS name FROM part JOIN wanted w ON lower(replace(p_name, ' ', '')) = lower(replace(w.wanted, ' ', ''))
  UNION ALL SELECT w.wanted, 'suppliers', CAST(s_suppkey AS VARCHAR), s_name FROM supplier JOIN wanted w ON lower(replace(s_name, ' ', '')) = lower(replace(w.wanted, ' ', ''))
) SELECT wanted, domain, code, name FROM (SELECT *, row_number() OVER (PARTITION BY wanted, domain ORDER BY code) AS n FROM found) WHERE n <= 2
""")
def identity_probe(spark, d):
    domains = {"parts": (table(spark, d, "part"), "p_partkey", "p_name"), "suppliers": (table(spark, d, "supplier"), "s_suppkey", "s_name")}
    return joins.identity_probe(domains, ["Red widget", "Brand#5", "Supplier#000000001"])


@query("""
SELECT c.c_custkey, s.s_suppkey, c.k AS matched_key FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'KR000' ELSE ' ' || CAST(c_custkey AS VARCHAR) || ' ' END AS k0, trim(CASE WHEN c_custkey % 10 = 0 THEN 'KR000' ELSE CAST(c_custkey AS VARCHAR) END) AS k FROM customer) c
JOIN supplier s ON c.k = CAST(s.s_suppkey AS VARCHAR) WHERE c.k <> '' AND NOT regexp_matches(c.k, '^(KR)?0+$')
""")
def cross_market(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "KR000").otherwise(F.concat(F.lit(" "), "c_custkey", F.lit(" "))).alias("k"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("k2"))
    return joins.cross_market(c, "k", s, "k2").select("c_custkey", "s_suppkey", "matched_key")


@query("""
WITH f AS (SELECT p_partkey, CASE p_partkey WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'D' ELSE 'Z' END AS c, CASE p_partkey WHEN 1 THEN p_type WHEN 2 THEN (SELECT p_type FROM part WHERE p_partkey = 1) WHEN 3 THEN 'other' WHEN 4 THEN 'KR000' ELSE p_type END AS k FROM part),
asked(pair, a, b) AS (VALUES ('AB', 'A', 'B'), ('AC', 'A', 'C'), ('AD', 'A', 'D'), ('AZ', 'A', 'Z')),
found AS (SELECT pair, count(*) AS n, count(DISTINCT c) AS classes, count(DISTINCT k) AS keys, sum(CASE WHEN k = 'KR000' THEN 1 ELSE 0 END) AS bad, min(k) AS k FROM asked JOIN f ON f.c IN (a, b) GROUP BY pair)
SELECT pair, CASE WHEN n <> 2 OR classes <> 2 THEN 'not_unique' WHEN bad > 0 THEN 'key_missing' WHEN keys = 1 THEN 'same' ELSE 'different' END AS status, CASE WHEN n = 2 AND classes = 2 AND bad = 0 AND keys = 1 THEN k END AS k FROM found
""")
def same_fund(spark, d):
    p = table(spark, d, "part")
    code = F.coalesce(F.get(F.array(*map(F.lit, "ABCD")), (F.col("p_partkey") - 1).cast("int")), F.lit("Z"))
    first = p.filter("p_partkey = 1").select(F.col("p_type").alias("first"))
    key = F.when(F.col("p_partkey") == 2, F.lit(first.first()["first"])).when(F.col("p_partkey") == 3, "other").when(F.col("p_partkey") == 4, "KR000").otherwise(F.col("p_type"))
    funds = p.select(F.concat(F.lit("fund Class "), code).alias("title"), key.alias("k"))
    return federate.union_all([joins.same_fund(funds, "title", list(pair), ["k"]).select(F.lit(pair).alias("pair"), "status", "k") for pair in ("AB", "AC", "AD", "AZ")])


@query("""
SELECT p_partkey, CASE WHEN p_brand = 'Brand#5' THEN 'by ticker' WHEN p_type = 'PROMO' THEN 'by isin' WHEN position('REDWIDGET' IN upper(replace(p_name, ' ', ''))) > 0 THEN 'by long name' WHEN position('WIDGET' IN upper(replace(p_name, ' ', ''))) > 0 THEN 'by name' END AS document,
  CASE WHEN p_brand = 'Brand#5' THEN 'ticker' WHEN p_type = 'PROMO' THEN 'isin' WHEN position('WIDGET' IN upper(replace(p_name, ' ', ''))) > 0 THEN 'name' END AS matched_by FROM part
""")
def provenance(spark, d):
    docs = spark.createDataFrame([("by ticker", "brand#5", None, "x y z q"), ("by isin", None, "promo", "x y z q"), ("by long name", None, None, "red (widget)"), ("by name", None, None, "widget")], "document string, ticker string, isin string, name string")
    return joins.provenance(table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name"), "p_partkey", ["p_brand", "p_type", "p_name"], docs).select("p_partkey", "document", "matched_by")


@query("""
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'fx:promo' WHEN p_type = 'LARGE' THEN 'fx:large' END AS uri FROM part
""")
def label_join(spark, d):
    labels = spark.createDataFrame([("PROMO", "fx:promo"), ("LARGE", "fx:large"), ("SMALL", "fx:small"), ("SMALL", "fx:little")], "label string, uri string")
    return joins.unique_label(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", labels, "label", "uri").select("p_partkey", "uri")


# --- unions, handoffs, previews


@query("""
SELECT code, name, domain, sort_value FROM (SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name, 'customers' AS domain, c_acctbal AS sort_value FROM customer
  UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 'suppliers', s_acctbal FROM supplier) WHERE sort_value IS NOT NULL ORDER BY sort_value DESC, domain, code LIMIT 10
""")
def merge_rank(spark, d):
    return federate.merge_rank(_parts(spark, d), "desc", 10)


def _parts(spark, d):
    c, sort = _compiler(spark, d), {"attribute": "balance", "order": "desc", "limit": 10}
    return [c.compile({"domain": x, "sort": sort}, merge=True).rows for x in ("customers", "suppliers")]


@query("""
WITH u AS (SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name, 'customers' AS domain, c_acctbal AS sort_value FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 'suppliers', s_acctbal FROM supplier),
top AS (SELECT * FROM u ORDER BY sort_value DESC, domain, code LIMIT 10),
details AS (SELECT 'customers' AS domain, CAST(c_custkey AS VARCHAR) AS code, c_nationkey AS nation FROM customer UNION ALL SELECT 'suppliers', CAST(s_suppkey AS VARCHAR), s_nationkey FROM supplier UNION ALL SELECT 'suppliers', CAST(s_suppkey AS VARCHAR), 99 FROM supplier),
one AS (SELECT domain, code, CASE WHEN count(*) = 1 THEN max(nation) END AS nation FROM details GROUP BY domain, code)
SELECT top.code, top.domain, top.sort_value, one.nation FROM top LEFT JOIN one USING (domain, code)
""")
def merge_rank_hydrate(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    customers = c.select(F.lit("customers").alias("domain"), F.col("c_custkey").cast("string").alias("code"), F.col("c_nationkey").alias("nation"))
    suppliers = s.select(F.lit("suppliers").alias("domain"), F.col("s_suppkey").cast("string").alias("code"), F.explode(F.array("s_nationkey", F.lit(99))).alias("nation"))
    return federate.merge_rank_hydrate(_parts(spark, d), "desc", 10, federate.union_all([customers, suppliers])).select("code", "domain", "sort_value", "nation")


def _codes(spark, d, name, key, where):
    return table(spark, d, name).filter(where).select(F.col(key).alias("code"))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 1)")
def handoff_intersect(spark, d):
    return federate.handoff(table(spark, d, "part").select("p_partkey"), "p_partkey", [[_codes(spark, d, "lineitem", "l_partkey", "l_quantity = 50")], [_codes(spark, d, "lineitem", "l_partkey", "l_returnflag = 'R' AND l_quantity = 1")]])


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 UNION SELECT l_partkey FROM lineitem WHERE l_quantity = 1)")
def handoff_union(spark, d):
    return federate.handoff(table(spark, d, "part").select("p_partkey"), "p_partkey", [[_codes(spark, d, "lineitem", "l_partkey", "l_quantity = 50"), _codes(spark, d, "lineitem", "l_partkey", "l_quantity = 1")]])


@query("""
WITH m AS (SELECT 'c' AS domain, c_custkey AS code FROM customer WHERE c_custkey < 4 UNION ALL SELECT 's', s_suppkey FROM supplier UNION ALL SELECT 'p', p_partkey FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY code) AS n FROM m)
SELECT domain, code FROM (SELECT *, row_number() OVER (ORDER BY n > 6, domain, n) AS place FROM r) WHERE place <= 20
""")
def fair_preview(spark, d):
    c, s, p = (table(spark, d, x) for x in ("customer", "supplier", "part"))
    rows = federate.union_all([c.filter("c_custkey < 4").select(F.lit("c").alias("domain"), F.col("c_custkey").alias("code")), s.select(F.lit("s").alias("domain"), F.col("s_suppkey").alias("code")), p.select(F.lit("p").alias("domain"), F.col("p_partkey").alias("code"))])
    return federate.fair_preview(rows, "domain", [F.col("code")], 20)


@query("SELECT l_partkey, l_quantity, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1")
def max_score(spark, d):
    return federate.max_score(table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_orderkey", "l_linenumber"), "l_partkey", "l_quantity").drop("l_linenumber")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_wins(spark, d):
    return federate.first_wins(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT 'c' AS _domain, 's1' AS _step_id, c_custkey AS code, c_mktsegment AS segment, NULL AS nation FROM customer UNION ALL SELECT 's', 's2', s_suppkey, NULL, s_nationkey FROM supplier")
def merge_tagged(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("nation"))
    return federate.union_all([federate.tagged(c, "c", "s1"), federate.tagged(s, "s", "s2")])


@query("SELECT s_nationkey AS uri, list_sort(list(DISTINCT s_name)) AS names, list_sort(list(DISTINCT CAST(s_suppkey AS VARCHAR))) AS codes, max(s_name) AS name FROM supplier GROUP BY s_nationkey")
def entity_fold(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("uri"), "s_name", F.col("s_suppkey").cast("string").alias("code"))
    return federate.fold_entities(s, "uri", "s_name", "code")


# --- vectors and documents


def _chunks(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), F.col("label").cast("string").alias("section_type"), "embedding")


QUERY_VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_LITERAL = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
_COSINE = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_LITERAL})"


@query(f"SELECT vec_id AS chunk_id, round({_COSINE}, 6) AS score FROM embeddings ORDER BY {_COSINE} DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    return vector.top_k(_chunks(spark, d), QUERY_VECTOR, 10).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"""
WITH hits AS (SELECT * FROM (SELECT vec_id, {_COSINE} AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY {_COSINE} DESC, vec_id LIMIT 20)
  UNION ALL SELECT * FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 3) AS DOUBLE[])) AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY 2 DESC, vec_id LIMIT 20))
SELECT h.vec_id AS chunk_id, round(max(h.score), 3) AS score, CASE WHEN h.vec_id % 2 = 0 THEN (SELECT CAST(label AS VARCHAR) FROM embeddings e WHERE e.vec_id = h.vec_id) ELSE '' END AS title, coalesce((SELECT list_sort(list(DISTINCT l_partkey)) FROM lineitem WHERE l_orderkey = h.vec_id), []) AS product_ids FROM hits h GROUP BY h.vec_id HAVING max(h.score) >= 0.25
""")
def vector_search(spark, d):
    second = [float(x) for x in table(spark, d, "embeddings").filter("vec_id = 3").first().embedding]
    bridge = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("product_id"))
    hits = vector.search(_chunks(spark, d), [QUERY_VECTOR, second], 20, bridge, ["1", "2", "3"], 0.25)
    return vector.normalised(hits.withColumn("title", F.when(F.col("chunk_id") % 2 == 0, F.col("section_type"))), ["title", "section_type"]).select("chunk_id", "score", "product_ids", "title")


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE CAST(p_partkey AS VARCHAR) IN ('1', '2') OR p_name = 'red widget' OR p_brand = 'red widget'))")
def semi_scope(spark, d):
    products = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_partkey").cast("string").alias("source_key"), F.col("p_name").alias("name"), F.col("p_brand").alias("short_name"))
    bridge = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("product_id"))
    return vector.in_scope(_chunks(spark, d), bridge, vector.scope(products, ["1", "2", "red widget"])).select("chunk_id")


@query("""
SELECT CASE WHEN s = 'matched_exact' THEN 'matched' WHEN s = 'unavailable' THEN s ELSE 'unknown' END AS status, count(*) AS n FROM (
  SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'matched_exact' WHEN l.quality = 0 THEN 'unavailable' END, 'unknown') AS s FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1
""")
def coverage_hist(spark, d):
    products = table(spark, d, "documents").select(F.col("doc_id").alias("product_id"))
    states = table(spark, d, "labels").select(F.col("doc_id").alias("product_id"), F.when(F.col("quality") == 1, "matched_exact").otherwise("unavailable").alias("status"))
    return vector.coverage_histogram(vector.coverage(products, states))


@query("""
SELECT d.doc_id AS document_id, l.doc_id AS chunk_id, d.n_chars AS published_at FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE d.source IN ('src1', 'src2', 'src0') AND position('hatible' IN lower(replace(d.source || ' ' || CASE WHEN l.doc_id IS NULL THEN '' ELSE d.text END, ' ', ''))) > 0 ORDER BY d.n_chars DESC NULLS LAST, d.doc_id, l.doc_id LIMIT 20
""")
def phrase_search(spark, d):
    docs = table(spark, d, "documents")
    documents = docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.col("source").alias("source_type"), F.col("n_chars").alias("published_at"))
    chunks = docs.join(table(spark, d, "labels"), "doc_id", "left_semi").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    return vector.phrase_search(documents, chunks, "Hatible", ["src1", "src2", "src0"]).select("document_id", "chunk_id", "published_at")


# --- graph


FIXTURE_TTL = """
@prefix fp: <http://example.org/fx#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
fp:Organization a owl:Class . fp:Company a owl:Class ; rdfs:subClassOf fp:Organization . fp:Product a owl:Class ; rdfs:label "Product"@en .
fp:ETF a owl:Class ; rdfs:subClassOf fp:Product ; rdfs:label "ETF"@en . fp:PublicFund a owl:Class ; rdfs:subClassOf fp:Product .
fp:Security a owl:Class . fp:Holding a owl:Class . fp:SubsidiaryRelation a owl:Class . fp:Theme a owl:Class . fp:Document a owl:Class .
fp:hasHolding a owl:ObjectProperty ; rdfs:domain [ owl:unionOf ( fp:ETF fp:PublicFund ) ] ; rdfs:range fp:Holding .
fp:holdingSecurity a owl:ObjectProperty ; rdfs:domain fp:Holding ; rdfs:range fp:Security .
fp:issuedByCompany a owl:ObjectProperty ; rdfs:domain fp:Security ; rdfs:range fp:Company .
fp:hasSubsidiary a owl:ObjectProperty ; rdfs:domain fp:Company ; rdfs:range fp:SubsidiaryRelation .
fp:subsidiaryCompany a owl:ObjectProperty ; rdfs:domain fp:SubsidiaryRelation ; rdfs:range fp:Company .
fp:relatedToTheme a owl:ObjectProperty ; rdfs:domain fp:ETF ; rdfs:range fp:Theme .
fp:ceoName a owl:DatatypeProperty ; rdfs:domain fp:Company . fp:organizationName a owl:DatatypeProperty ; rdfs:domain fp:Organization . fp:corpCode a owl:DatatypeProperty ; rdfs:domain fp:Company .
fp:productCode a owl:DatatypeProperty ; rdfs:domain fp:Product ; fp:sourceTable "orders" ; fp:sourceColumn "o_orderkey" .
fp:productShortName a owl:DatatypeProperty ; rdfs:domain fp:Product . fp:weight a owl:DatatypeProperty ; rdfs:domain fp:Holding .
fp:asOf a owl:DatatypeProperty . fp:sourceId a owl:DatatypeProperty . fp:securityCode a owl:DatatypeProperty ; rdfs:domain fp:Security .
fp:themeName a owl:DatatypeProperty ; rdfs:domain fp:Theme . fp:ownershipPct a owl:DatatypeProperty ; rdfs:domain fp:SubsidiaryRelation .
"""
NAMESPACE = "http://example.org/fx#"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


_STORES: dict[tuple[str, str], Graph] = {}


def fixture_graph(spark: SparkSession, d: str) -> Graph:
    """The stored graph of `fixture_triples`, written once a session and folder of tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        path, ontology = f"{shared_dir(spark)}/lattica-graph-{uuid.uuid4().hex}", Ontology(parse(FIXTURE_TTL), NAMESPACE)
        Graph(fixture_triples(spark, d), ontology).store(path)
        _STORES[key] = Graph.stored(spark, path, ontology)
    return _STORES[key]


def fixture_triples(spark: SparkSession, d: str) -> DataFrame:
    """Orders as products holding line items (holdings) of suppliers (securities) of nations (companies), subsidiaries of regions; words of part names as themes."""
    parts = []

    def add(name: str, rows: DataFrame, subject, target) -> None:
        predicate = TYPE if name == "type" else NAMESPACE + name
        parts.append(rows.select(subject.cast("string").alias("s"), F.lit(predicate).alias("p"), target.cast("string").alias("o")))

    node = lambda kind, *keys: F.concat(F.lit(f"{kind}/"), *[x for k in keys for x in (F.col(k), F.lit("-"))])
    line, order, supplier, nation, region, part = (table(spark, d, x) for x in ("lineitem", "orders", "supplier", "nation", "region", "part"))
    holding = node("holding", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    add("hasHolding", line, node("order", "l_orderkey"), holding)
    add("holdingSecurity", line, holding, node("supplier", "l_suppkey"))
    add("weight", line, holding, F.col("l_extendedprice"))
    add("asOf", line, holding, F.date_format("l_shipdate", "yyyy-MM-dd"))
    add("sourceId", line, holding, F.col("l_linestatus"))
    add("type", order, node("order", "o_orderkey"), F.lit(NAMESPACE + "ETF"))
    add("productCode", order, node("order", "o_orderkey"), F.col("o_orderkey"))
    add("productShortName", order, node("order", "o_orderkey"), F.col("o_orderpriority"))
    add("type", supplier, node("supplier", "s_suppkey"), F.lit(NAMESPACE + "Security"))
    add("issuedByCompany", supplier, node("supplier", "s_suppkey"), node("nation", "s_nationkey"))
    add("securityCode", supplier, node("supplier", "s_suppkey"), F.col("s_name"))
    add("type", nation, node("nation", "n_nationkey"), F.lit(NAMESPACE + "Company"))
    add("organizationName", nation, node("nation", "n_nationkey"), F.col("n_name"))
    add("hasSubsidiary", nation, node("region", "n_regionkey"), node("owns", "n_nationkey"))
    add("subsidiaryCompany", nation, node("owns", "n_nationkey"), node("nation", "n_nationkey"))
    add("corpCode", nation, node("nation", "n_nationkey"), F.col("n_nationkey"))
    add("ownershipPct", nation, node("owns", "n_nationkey"), F.col("n_nationkey") + 50)
    add("asOf", nation, node("owns", "n_nationkey"), F.when(F.col("n_nationkey") % 4 > 0, "1997-01-01"))
    add("sourceId", nation, node("owns", "n_nationkey"), F.lit("register"))
    add("type", region, node("region", "r_regionkey"), F.lit(NAMESPACE + "Company"))
    add("organizationName", region, node("region", "r_regionkey"), F.col("r_name"))
    words = part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    add("relatedToTheme", words, node("part", "p_partkey"), node("theme", "word"))
    add("themeName", words, node("theme", "word"), F.col("word"))
    add("type", words, node("theme", "word"), F.lit(NAMESPACE + "Theme"))
    add("productCode", part, node("part", "p_partkey"), F.concat(F.lit("P"), "p_partkey"))
    add("productShortName", part, node("part", "p_partkey"), F.col("p_name"))
    return federate.union_all(parts).filter("o is not null")


HOLDERS = Plan(
    {"seed": "Company", "security": "Security", "holding": "Holding", "etf": "ETF"},
    (Edge("security", "issuedByCompany", "seed"), Edge("holding", "holdingSecurity", "security"), Edge("etf", "hasHolding", "holding")),
    (Output("etf", "productCode", "etf_code"), Output("etf", "productShortName", "etf_name"), Output("holding", "weight", "weight", True)), 500,
)


@query("""
SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS etf_code, o_orderpriority AS etf_name, CAST(l_extendedprice AS DOUBLE) AS weight, strftime(l_shipdate, '%Y-%m-%d') AS as_of, l_linestatus AS source
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey
WHERE n_name = 'NATION_7' AND strftime(l_shipdate, '%Y-%m-%d') <= '1995-03-15'
""")
def holding_chain(spark, d):
    """All rows of a plan of four nodes, with an optional output, evidence and cut-off."""
    g = fixture_graph(spark, d)
    rows, _ = g.run(HOLDERS, g.resolve("NATION_7", "Company"), cutoff="1995-03-15", capped=False)
    return rows.select("etf_code", "etf_name", F.col("weight").cast("double").alias("weight"), F.col("holding_as_of").alias("as_of"), F.col("holding_source").alias("source")).distinct()


@query("""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT etf_code) AS BIGINT) AS codes, CAST(count(weight) AS BIGINT) AS weights FROM (
  SELECT DISTINCT o_orderkey AS etf_code, o_orderpriority, l_extendedprice AS weight, l_shipdate, l_linestatus FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
  WHERE s_nationkey = 7 AND l_shipdate <= TIMESTAMP '1997-01-20')
""")
def graph_plan(spark, d):
    """The compiled plan, whole."""
    g = fixture_graph(spark, d)
    rows, _ = g.run(HOLDERS, g.resolve("NATION_7", "Company"), cutoff="1997-01-20", capped=False)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("etf_code").alias("codes"), F.count("weight").alias("weights"))


@query("SELECT n_name AS child_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def graph_subsidiaries(spark, d):
    from lattica.operators.graph import subsidiaries

    g = fixture_graph(spark, d)
    plan = subsidiaries()
    plan = Plan(plan.nodes, plan.edges, tuple(o for o in plan.outputs if o.alias == "child_name"), plan.limit)
    return g.run(plan, g.resolve("asia", "Company"), cutoff="2000-01-01")[0].select("child_name")


@query("""
SELECT CASE WHEN count(*) = 0 THEN 'empty' WHEN sum(CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END) > 0 THEN 'abstain_evidence_missing' ELSE 'ok' END AS status, count(*) AS rows, CAST(coalesce(sum(CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS missing
FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')
""")
def evidence_gate(spark, d):
    from lattica.operators.graph import subsidiaries

    g = fixture_graph(spark, d)
    rows, held = g.run(Plan(subsidiaries().nodes, subsidiaries().edges, subsidiaries().outputs[:1], 100), g.resolve("ASIA", "Company"), cutoff="2000-01-01")
    return evidence.evidence_gate(rows, [c for c in held if c.endswith(("_as_of", "_source"))])


@query("""
SELECT DISTINCT 'P' || p_partkey AS code, p_name AS name FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'widget')
""")
def theme_facets(spark, d):
    return fixture_graph(spark, d).theme_members(["red", "widget"]).select("code", "name")


@query("SELECT 'region/' || r_regionkey || '-' AS uri, CAST(r_regionkey AS INTEGER) AS k FROM region WHERE r_name = 'AMERICA'")
def entity_resolution(spark, d):
    found = fixture_graph(spark, d).resolve("amer ica", "Company")
    return spark.createDataFrame([(found.uri, int(found.uri.split("/")[1].strip("-")))], "uri string, k int")


@query("""
WITH t AS (SELECT p_partkey, string_split(lower(p_name), ' ')[1] AS a, string_split(lower(p_name), ' ')[2] AS b, lower(p_brand) AS c FROM part)
SELECT DISTINCT p_partkey, unnest([a, b, c, a || '/' || b, b || '/' || c, a || '/' || b || '/' || c]) AS segment FROM t
""")
def segment_index(spark, d):
    label = F.concat(F.replace("p_name", F.lit(" "), F.lit("/ ")), F.lit("/"), "p_brand", F.lit("/"))
    return table(spark, d, "part").select("p_partkey", F.explode(t.segment_keys(label)).alias("segment"))


@query("""
WITH RECURSIVE up(a, b) AS (SELECT n, n FROM (SELECT s_suppkey AS n FROM supplier UNION SELECT s_suppkey // 2 FROM supplier) UNION SELECT u.a, u.b // 2 FROM up u WHERE u.b > 0) SELECT DISTINCT a, b FROM up
""")
def closure(spark, d):
    from lattica.operators.ontology import closure_by_rounds

    s = table(spark, d, "supplier").filter("s_suppkey > 0").select(F.col("s_suppkey").alias("a"), F.expr("s_suppkey div 2").alias("b"))
    return closure_by_rounds(s)


# --- views and evidence


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1998-01-01' AND (o_orderkey % 2 = 0 OR DATE '1998-01-01' < CAST(o_orderdate AS DATE) + 400) THEN 'true' ELSE 'false' END AS listed FROM orders
""")
def listing_view(spark, d):
    o = table(spark, d, "orders")
    end = F.when(F.col("o_orderkey") % 2 == 0, "99991231").otherwise(F.date_format(F.date_add("o_orderdate", 400), "yyyyMMdd"))
    return o.select("o_orderkey", views.listing(F.date_format("o_orderdate", "yyyyMMdd"), end, F.lit("19980101"))["value"].alias("listed"))


@query("""
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN days < 0 THEN '만기경과' WHEN days / 365.0 < 1 THEN '1년미만' WHEN days / 365.0 < 3 THEN '1-3년' WHEN days / 365.0 < 5 THEN '3-5년' WHEN days / 365.0 < 10 THEN '5-10년' ELSE '10년이상' END AS bucket
  FROM (SELECT date_diff('day', DATE '1997-06-01', CAST(l_shipdate AS DATE)) AS days FROM lineitem)) GROUP BY bucket
""")
def maturity_bucket(spark, d):
    line = table(spark, d, "lineitem").select(views.maturity(F.date_format("l_shipdate", "yyyyMMdd"), F.lit("19970601"))["value"].alias("bucket"))
    return line.groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, 'balance=' || CASE WHEN c_custkey % 3 = 0 THEN 'NULL' ELSE CAST(c_nationkey AS VARCHAR) END || ', other=no column' AS value, CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE 'available' END AS status FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, NULL, 'null' FROM customer WHERE c_custkey % 3 = 0")
def return_series_view(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("b"))
    return views.derive(c, "x", OutputView("return_series", ("b", "gone"), periods=("balance", "other"))).select("c_custkey", "x.value", "x.status")


@query("SELECT p_partkey, 'Kind=' || CASE p_type WHEN 'PROMO' THEN 'fx:promo' WHEN 'LARGE' THEN 'fx:large' ELSE 'unresolved' END AS value FROM part")
def classification_view(spark, d):
    labels = spark.createDataFrame([("Kind", "PROMO", "fx:promo"), ("Kind", "LARGE", "fx:large"), ("Kind", "SMALL", "fx:a"), ("Kind", "SMALL", "fx:b")], "axis string, label string, uri string")
    return views.derive(table(spark, d, "part").select("p_partkey", "p_type"), "x", OutputView("classification", ("p_type",), axes=(("p_type", "Kind"),)), labels=labels, key="p_partkey").select("p_partkey", "x.value")


@query("""
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN ' ' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_nationkey + 1 END AS nation, c_acctbal FROM customer)
SELECT field, status, count(*) AS n FROM (
  SELECT 'name' AS field, CASE WHEN name IS NULL THEN 'null' WHEN trim(name) = '' THEN 'empty' ELSE 'available' END AS status FROM r
  UNION ALL SELECT 'nation', CASE WHEN nation = 0 THEN 'zero_unavailable' ELSE 'available' END FROM r UNION ALL SELECT 'balance', 'restricted' FROM r
  UNION ALL SELECT 'gone', 'not_selected' FROM r UNION ALL SELECT 'vague', 'unmapped' FROM r) GROUP BY field, status
""")
def field_contract(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 5 == 1, " ").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 4 == 0, 0).otherwise(F.col("c_nationkey") + 1).alias("nation"), "c_acctbal"
    )
    fields = [
        {"field": "name", "column": "name"}, {"field": "nation", "column": "nation", "rule": "0 = 값 없음"}, {"field": "balance", "column": "c_acctbal", "rule": "사용 금지"},
        {"field": "gone", "column": "gone"}, {"field": "vague", "column": ["a", "b"]}, {"field": " N ame", "column": "name"},
    ]
    return evidence.contract(c, "c_custkey", fields).groupBy("field", "status").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, (SELECT string_agg(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '@' || strftime(l_shipdate, '%Y%m%d'), ' ' ORDER BY l_quantity, strftime(l_shipdate, '%Y%m%d')) FROM lineitem WHERE l_orderkey = o_orderkey) AS evidence FROM orders
""")
def graph_evidence(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.date_format("l_shipdate", "yyyyMMdd").alias("day"))
    rows = evidence.with_graph_evidence(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", line, "l_orderkey", ["l_quantity", "day"])
    return rows.select("o_orderkey", F.array_join(F.transform("evidence", lambda x: F.concat(x["l_quantity"].cast("int"), F.lit("@"), x["day"])), " ").alias("evidence"))
