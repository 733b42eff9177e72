"""Registered queries for whole requests, the four product domains, plans, sources and driver-side decisions, with DuckDB SQL.

Product tables are stood in for by the star schema: orders are bonds and overseas ETFs, parts domestic ETFs, customers
funds. What is decided on the driver (literals, plans, statuses) comes out as a table of cases.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.catalogue_queries import CATALOG, HOLDERS, NAMESPACE, QUERY_VECTOR, fixture_graph, query
from lattica.errors import RequestError, Truncated, Unavailable
from lattica.functions import literals
from lattica.functions import text as t
from lattica.functions import values as v
from lattica.operators import evidence, graph, vector, views
from lattica.operators.graph import Graph
from lattica.operators.ontology import Ontology
from lattica.plans import planner, wording
from lattica.plans.catalog import Catalog, Domain, OutputView
from lattica.plans.compile import SORTED, TESTED, Compiler
from lattica.plans.engine import Engine, rows_shown
from lattica.plans.products import PRODUCTS, RATINGS
from lattica.session import shared_dir, table
from lattica.sources import io, stores
from lattica.sources.turtle import parse

TODAY = date(2026, 8, 24)
TABLES = ("orders", "part", "lineitem", "customer", "supplier")


def _cases(spark: SparkSession, cases: dict[str, object]) -> DataFrame:
    return spark.createDataFrame([(k, str(x)) for k, x in cases.items()], "item string, said string")


def _values(**cases: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{x}')" for k, x in cases.items()) + ") c(item, said)"


def _error(call) -> str:
    """The kind of error of a call, or ok."""
    try:
        call()
    except (RequestError, Truncated, Unavailable) as e:
        return type(e).__name__
    return "ok"


# --- whole requests


def _engine(spark: SparkSession, d: str, **options) -> Engine:
    return Engine(CATALOG, {n: table(spark, d, n) for n in TABLES}, fixture_graph(spark, d), **options)


def _holds(entity: str, **more) -> dict:
    return {"id": "r", "relation": "holds", "object_entity": entity, "entity_role": "company", "subject_domain": "", **more}


def _given(spark: SparkSession, done: dict, step: str, schema: str) -> DataFrame:
    """A step's rows, none if it had none to give."""
    rows = done[step].rows
    return spark.createDataFrame([], schema) if rows is None else rows


_HELD = "SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE {}"


@query(f"SELECT o_orderkey AS code, o_totalprice AS price FROM orders WHERE o_orderkey IN ({_HELD.format("n_name = 'NATION_7'")}) ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def request_ranked_over_relation(spark, d):
    """The best of all products that a relation leads to, however many they are."""
    intent = {"product_domain": [{"domain": "orders"}], "relations": [_holds("NATION_7")], "sort": {"attribute": "price", "order": "desc", "limit": 5}}
    _, done, _ = _engine(spark, d).run(intent, TODAY)
    rows = _given(spark, done, "tables_orders", f"code bigint, `{SORTED.format('price')}` double")
    return rows.select("code", F.col(f"`{SORTED.format('price')}`").alias("price"))


@query(f"SELECT o_orderkey AS code FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey IN ({_HELD.format("n_name = 'NATION_3' AND l_extendedprice >= 50000")})")
def request_relation_condition(spark, d):
    """A condition on the relation holds before anything is handed on."""
    conditions = [{"attribute": "weight", "operator": "gte", "value": "50000", "applies_to": "r"}, {"attribute": "priority", "operator": "eq", "value": "1-URGENT"}]
    _, done, _ = _engine(spark, d).run({"product_domain": [{"domain": "orders"}], "relations": [_holds("NATION_3")], "conditions": conditions}, TODAY)
    return _given(spark, done, "tables_orders", "code bigint").select("code")


@query(f"SELECT o_orderkey AS code FROM orders WHERE o_orderkey IN ({_HELD.format("n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') AND n_nationkey % 4 <> 0")})")
def request_company_or_subsidiaries(spark, d):
    """Holders of a company or of its subsidiaries: one list of two has nothing, the other decides."""
    relations = [_holds("ASIA", id="own"), {"id": "sub", "relation": "subsidiary_of", "object_entity": "ASIA", "entity_role": "company"}, {"id": "via", "relation": "holds", "object_ref": "sub", "subject_domain": ""}]
    dated = {"attribute": "relation_as_of", "operator": "eq", "value": "1997-01-01", "applies_to": "via"}
    _, done, _ = _engine(spark, d).run({"product_domain": [{"domain": "orders"}], "relations": relations, "conditions": [dated], "any_relation": True}, TODAY)
    return _given(spark, done, "tables_orders", "code bigint").select("code")


@query("""
WITH u AS (SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name, 'customers' AS domain, c_acctbal AS sort_value, c_mktsegment AS segment FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 'suppliers', s_acctbal, NULL FROM supplier)
SELECT * FROM u ORDER BY sort_value DESC, domain, code LIMIT 30
""")
def request_merged_and_hydrated(spark, d):
    """One ranking over two domains; what is shown of the winners is looked up after it."""
    intent = {"product_domain": [{"domain": "customers"}, {"domain": "suppliers"}], "sort": {"attribute": "balance", "order": "desc", "limit": 30}, "output_requirements": {"fields": ["segment"]}}
    return _engine(spark, d).run(intent, TODAY)[2].select("code", "name", "domain", "sort_value", "segment")


@query("""
SELECT o_orderkey AS code, field, CASE field WHEN 'customer' THEN c_name WHEN 'segment' THEN c_mktsegment WHEN 'priority' THEN o_orderpriority END AS value, CASE WHEN field = 'gone' THEN 'unmapped' ELSE 'available' END AS status
FROM orders JOIN customer ON c_custkey = o_custkey, (VALUES ('customer'), ('segment'), ('priority'), ('gone')) f(field) WHERE o_totalprice > 400000
""")
def request_contract(spark, d):
    """Evidence by field of a request, a field of two names split in two."""
    intent = {"product_domain": [{"domain": "orders"}], "conditions": [{"attribute": "total", "operator": "gt", "value": "400,000"}], "output_requirements": {"fields": ["customer·segment", "priority", "gone"]}}
    return _engine(spark, d).answer(intent, today=TODAY).contracts["tables_orders"].select("code", "field", "value", "status")


@query("""
SELECT _domain, code FROM (SELECT 'customers' AS _domain, CAST(c_custkey AS VARCHAR) AS code, row_number() OVER (ORDER BY c_name, c_custkey) AS n FROM customer UNION ALL SELECT 'suppliers', CAST(s_suppkey AS VARCHAR), row_number() OVER (ORDER BY s_name, s_suppkey) FROM supplier) WHERE n <= 10
""")
def request_preview(spark, d):
    """An even share of each domain's rows."""
    return _engine(spark, d).answer({"product_domain": [{"domain": "customers"}, {"domain": "suppliers"}]}, today=TODAY).preview.select("_domain", F.col("code").cast("string").alias("code"))


def _bond_orders(spark: SparkSession, d: str) -> DataFrame:
    """Bonds: their issuer is the nation of the order's customer."""
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")


def _standin(domain: Domain, rows: DataFrame, **given: Column | str) -> DataFrame:
    """`rows` as the table of a domain: the given columns, nulls for the others that the catalog refers to."""
    made = {k: F.col(x) if isinstance(x, str) else x for k, x in given.items()}
    return rows.select(*[x.alias(k) for k, x in made.items()], *[F.lit(None).cast("string").alias(c) for c in sorted(domain.columns() - made.keys())])


def _bonds(spark: SparkSession, d: str) -> DataFrame:
    scale = RATINGS
    key = F.col("o_orderkey")
    return _standin(
        PRODUCTS["채권"], _bond_orders(spark, d), pd_no=key.cast("string"), pd_nm=F.concat(F.lit("bond "), key), pd_pbcm=F.concat(F.lit("(주) "), "n_name"), crd_grd=F.element_at(F.array(*map(F.lit, scale)), (key % len(scale) + 1).cast("int")),
        remaining_days=(key % 4000).cast("double"), applied_yield="o_totalprice", pd_exg_mkt=F.when(key % 3 == 0, "장내").otherwise("장외"), mat_dt=F.date_format("o_orderdate", "yyyyMMdd"), info_base_dt=F.lit("19970601"),
    )


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS code, '(주) ' || n_name AS issuer, o_totalprice AS rate FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderkey % 20 >= 16 AND o_orderkey % 4000 <= 3 * 365 AND o_orderkey % 3 = 0 ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 10
""")
def bonds_ranked(spark, d):
    """Ratings from AA- up, at most three years left, on the exchange, by yield."""
    request = {"domain": "채권", "subtypes": ["장내채권"], "fields": ["발행사"], "conditions": [{"attribute": "원신용등급", "operator": "gte", "value": "AA-"}, {"attribute": "잔존일수", "operator": "lte", "value": "3년"}], "sort": {"attribute": "민평수익률", "order": "desc", "limit": "10개"}}
    rows = Compiler(PRODUCTS, {"raw.prbd01n001": _bonds(spark, d)}).compile(request).rows
    return rows.select("code", F.col("발행사").alias("issuer"), F.col(f"`{SORTED.format('민평수익률')}`").alias("rate"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS code FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE') AND n_nationkey % 4 <> 0 AND o_orderkey % 20 = 19
""")
def bonds_by_issuers_of_relation(spark, d):
    """Bonds whose issuer is a subsidiary of a company: names are handed on, compared as names of organisations."""
    relation = {"id": "r", "relation": "subsidiary_of", "object_entity": "EUROPE", "entity_role": "company", "subject_domain": "발행기관"}
    conditions = [{"attribute": "relation_as_of", "operator": "eq", "value": "1997-01-01", "applies_to": "r"}, {"attribute": "신용등급", "operator": "eq", "value": "AAA"}]
    engine = Engine(PRODUCTS, {"raw.prbd01n001": _bonds(spark, d)}, fixture_graph(spark, d))
    _, done, _ = engine.run({"product_domain": [{"domain": "채권"}], "relations": [relation], "conditions": conditions}, TODAY)
    return _given(spark, done, "tables_채권", "code string").select("code")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS code, CASE WHEN days < 0 THEN '만기경과' WHEN days / 365.0 < 1 THEN '1년미만' WHEN days / 365.0 < 3 THEN '1-3년' WHEN days / 365.0 < 5 THEN '3-5년' WHEN days / 365.0 < 10 THEN '5-10년' ELSE '10년이상' END AS maturity,
  CASE o_orderkey % 20 WHEN 19 THEN 'AAA (http://example.org/fx#AAA)' WHEN 18 THEN 'AA+ (http://example.org/fx#AAp)' END AS rating, CASE WHEN o_orderkey % 20 >= 18 THEN 'available' ELSE 'unresolved' END AS status,
  CASE o_orderkey % 20 WHEN 19 THEN 'AAA' WHEN 18 THEN 'AA+' ELSE 'AA0' END AS stored
FROM (SELECT o_orderkey, date_diff('day', DATE '1997-06-01', CAST(o_orderdate AS DATE)) AS days FROM orders WHERE o_orderkey % 20 >= 17)
""")
def bonds_viewed(spark, d):
    """Output views of bonds in a request: maturity, the rating's individual, the stored rating."""
    ttl = "@prefix fp: <http://example.org/fx#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . fp:CreditRating a owl:Class . fp:AAA a fp:CreditRating ; rdfs:label \"AAA\" . fp:AAp a fp:CreditRating ; rdfs:label \"AA+\" ."
    engine = Engine(PRODUCTS, {"raw.prbd01n001": _bonds(spark, d)}, ontology=Ontology(parse(ttl), NAMESPACE))
    intent = {"product_domain": [{"domain": "채권"}], "conditions": [{"attribute": "신용등급", "operator": "gte", "value": "AA0"}], "output_requirements": {"fields": ["만기 구분", "정규화 등급값", "원등급"]}}
    rows = engine.run(intent, TODAY)[1]["tables_채권"].rows
    return rows.select("code", F.col("만기구분.value").alias("maturity"), F.col("온톨로지분류값.value").alias("rating"), F.col("온톨로지분류값.status").alias("status"), F.col("원본등급값.value").alias("stored"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS code, p_retailprice * 1000000000.0 AS aum, CAST(p_size AS DOUBLE) / 100.0 AS fee FROM part
WHERE p_size % 5 <> 0 AND p_retailprice * 1000000000.0 >= 1e12 AND p_partkey % 2 = 0 AND p_size % 4 - 2 < 0 AND p_size / 100.0 <= 0.3 AND p_name LIKE '%red%'
""")
def domestic_etfs(spark, d):
    """Kinds, amounts in won, an enrichment's fee, products on sale, names that contain a word; ETFs unless ETNs are asked for."""
    domain = PRODUCTS["국내ETF"]
    p = table(spark, d, "part")
    etfs = _standin(
        domain, p, pd_itm_no=F.col("p_partkey").cast("string"), pd_nm="p_name", pd_grp_no=F.when(F.col("p_size") % 5 == 0, "ETN").otherwise("ETF"), du_last_aum=F.col("p_retailprice") * 1e9,
        cu_lev_fector=(F.col("p_size") % 4 - 2).cast("double"), pd_sale_yn=F.when(F.col("p_partkey") % 2 == 0, "1").otherwise("0"),
    )
    fees = p.select(F.col("p_partkey").cast("string").alias("pd_itm_no"), (F.col("p_size") / 100.0).alias("expense_ratio"))
    tickers = p.select(F.col("p_partkey").cast("string").alias("pd_itm_no"), F.col("p_brand").alias("ticker"))
    request = {"domain": "국내ETF", "subtypes": ["인버스"], "on_sale": True, "conditions": [{"attribute": "현재AUM", "operator": "gte", "value": "1조원"}, {"attribute": "총보수", "operator": "lte", "value": "0.3"}, {"attribute": "상품명", "operator": "contains", "value": "RED"}]}
    rows = Compiler(PRODUCTS, {"raw.pref01n001": etfs, "enriched.expense_ratio": fees, "enriched.etf_kr": tickers}).compile(request).rows
    return rows.select("code", F.col(f"`{TESTED.format('현재AUM')}`").alias("aum"), F.col(f"`{TESTED.format('총보수')}`").alias("fee"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS code, o_totalprice * 1000.0 AS aum, 'USD' AS currency FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AND o_totalprice * 1000.0 >= 300000000 AND o_orderstatus IN ('F', 'O')
""")
def overseas_etfs(spark, d):
    """An amount in dollars is compared with rows in dollars only; nothing is converted."""
    o = table(spark, d, "orders")
    etfs = _standin(
        PRODUCTS["해외ETF"], o, pd_itm_no=F.col("o_orderkey").cast("string"), pd_nm="o_orderpriority", pd_grp_no=F.when(F.col("o_orderkey") % 5 == 0, "ETN").otherwise("ETF"), du_last_aum=F.col("o_totalprice") * 1000.0,
        pd_trd_ccy=F.when(F.col("o_orderkey") % 2 == 0, "USD").otherwise("KRW"), wu_inv_rgn="o_orderstatus",
    )
    request = {"domain": "해외ETF", "conditions": [{"attribute": "순자산(AUM)", "operator": "gte", "value": "3억달러"}, {"attribute": "투자지역", "operator": "in", "value": ["F", "O"]}]}
    rows = Compiler(PRODUCTS, {"raw.pref02n001": etfs}).compile(request).rows
    return rows.select("code", F.col(f"`{TESTED.format('순자산(AUM)')}`").alias("aum"), F.col(f"`{TESTED.format('pd_trd_ccy')}`").alias("currency"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS code, c_mktsegment || ' fund Class ' || substr('ABC', CAST(c_custkey % 3 + 1 AS INTEGER), 1) AS name, c_acctbal AS aum FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 IN (0, 2) AND c_custkey % 4 = 0 ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 15
""")
def funds_by_class(spark, d):
    """Share classes of funds that a name is part of, those on sale, by size."""
    c = table(spark, d, "customer")
    funds = _standin(
        PRODUCTS["펀드"], c, itm_no=F.col("c_custkey").cast("string"), itm_nm=F.concat("c_mktsegment", F.lit(" fund Class "), F.substr(F.lit("ABC"), (F.col("c_custkey") % 3 + 1).cast("int"), F.lit(1))),
        fd_nast_suma="c_acctbal", sale_yn=F.when(F.col("c_custkey") % 4 == 0, "판매중").otherwise("중지"),
    )
    request = {"domain": "펀드", "entity": "Building Fund", "class_suffixes": ["A", "c"], "on_sale": True, "sort": {"attribute": "AUM", "order": "desc", "limit": 15}}
    rows = Compiler(PRODUCTS, {"raw.prfd01n001": funds}).compile(request).rows
    return rows.select("code", "name", F.col(f"`{SORTED.format('AUM')}`").alias("aum"))


_SIM = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), [" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "])"
_MIS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), [" + ", ".join(f"{-x}::DOUBLE" for x in QUERY_VECTOR) + "])"


@query(f"""
WITH scope AS (SELECT vec_id, label, {_SIM} AS a, {_MIS} AS b FROM embeddings WHERE label IN (1, 2) AND vec_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')),
hits AS (SELECT * FROM (SELECT vec_id, a AS score FROM scope ORDER BY a DESC, vec_id LIMIT 20) UNION ALL SELECT * FROM (SELECT vec_id, b FROM scope ORDER BY b DESC, vec_id LIMIT 20))
SELECT vec_id AS chunk_id, round(max(score), 6) AS score FROM hits GROUP BY vec_id HAVING max(score) >= 0.1
""")
def request_documents_of_results(spark, d):
    """Chunks of the documents of all products that the table step found, in the sections that the topics hint at."""
    chunks, bridge = _documents(spark, d)
    engine = _engine(spark, d, chunks=chunks, bridge=bridge, embed=lambda x: QUERY_VECTOR if x == "전략" else [-y for y in QUERY_VECTOR], hints={"전략": "1", "위험": "2"}, floor=0.1)
    intent = {"product_domain": [{"domain": "orders"}], "conditions": [{"attribute": "priority", "operator": "eq", "value": "1-URGENT"}], "output_requirements": {"narrative_topics": ["전략", "위험"]}}
    return engine.run(intent, TODAY)[1]["vectors"].rows.select("chunk_id", F.round("score", 6).alias("score"))


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), F.col("label").cast("string").alias("section_type"), "embedding"), e.select(F.col("vec_id").alias("document_id"), F.col("vec_id").alias("product_id"))


@query(_values(not_found="abstain_entity_not_found blocked_upstream", two_products="abstain_entity_ambiguous blocked_upstream", undated="abstain_evidence_missing blocked_upstream", nobody="empty blocked_empty", no_plan="abstain_schema_unresolved blocked_upstream", no_attribute="invalid blocked_upstream", bad_value="invalid", unfinished_year="blocked", no_graph="unavailable blocked_upstream", no_vectors="ok abstain_vector_unavailable"))
def request_statuses(spark, d):
    """Why a request has no answer: each reason is told apart, and what depends on it doesn't run."""
    engine = _engine(spark, d)
    ask = lambda relation=None, **more: engine.run({"product_domain": [{"domain": "orders"}], **({"relations": [relation]} if relation else {}), **more}, TODAY)
    said = lambda run: " ".join(o.status for o in run[1].values() if not o.step.payload.get("lookup")) or ("blocked" if run[0].blockers else "")
    late = {"attribute": "holding_as_of", "operator": "gt", "value": "2026-01-01", "applies_to": "r"}
    cases = {
        "not_found": ask(_holds("NOWHERE")), "two_products": ask(_holds("F", entity_role="product")), "undated": ask({**_holds("ASIA"), "relation": "subsidiary_of"}),
        "nobody": ask(_holds("NATION_7"), conditions=[late | {"attribute": "holding_source", "operator": "eq", "value": "nobody"}]), "no_plan": ask({**_holds("NATION_7"), "relation": "likes"}),
        "no_attribute": ask(_holds("NATION_7"), conditions=[late | {"attribute": "colour"}]), "bad_value": ask(conditions=[{"attribute": "priority", "operator": "eq", "value": "9-LATER"}]), "unfinished_year": ask(full_years=[2026]),
        "no_graph": Engine(CATALOG, engine.compiler.tables).run({"product_domain": [{"domain": "orders"}], "relations": [_holds("X")]}, TODAY), "no_vectors": ask(output_requirements={"narrative_topics": ["a"]}),
    }
    return _cases(spark, {k: said(x) for k, x in cases.items()})


@query(_values(ok="ok", low_confidence="low_confidence", topic_not_covered="topic_not_covered", no_hit="no_hit", no_product_match="no_product_match", no_document="no_document", no_official_document="no_official_document", unresolved_product_scope="unresolved_product_scope", policy="ok", no_policy="no_official_document", unavailable="abstain_vector_unavailable"))
def search_statuses(spark, d):
    """All statuses of a document step, each from a request."""
    chunks, bridge = _documents(spark, d)
    docs = table(spark, d, "region").select(F.col("r_regionkey").alias("document_id"), F.col("r_name").alias("title"), F.lit("policy").alias("source_type"), F.col("r_regionkey").alias("published_at"))
    states = lambda s: bridge.select(F.col("product_id").cast("string").alias("product_id"), F.lit(s).alias("status"))
    urgent = [{"attribute": "priority", "operator": "eq", "value": "1-URGENT"}]

    def ask(conditions=urgent, floor=-1.0, own=chunks, own_bridge=bridge, question="", **more) -> str:
        e = _engine(spark, d, chunks=own, bridge=own_bridge, embed=lambda x: QUERY_VECTOR, floor=floor, **more)
        domain = [{"domain": "orders"}] if conditions is not None else []
        done = e.run({"product_domain": domain, "conditions": conditions or [], "output_requirements": {"narrative_topics": ["전략"]}}, TODAY, question)[1]
        return next(o.status for k, o in done.items() if k.startswith("vector"))

    nobody, text = [{"attribute": "priority", "operator": "eq", "value": "9"}], chunks.withColumn("chunk_text", F.lit(None).cast("string"))
    return _cases(spark, {
        "ok": ask(), "low_confidence": ask(floor=2.0), "topic_not_covered": ask(hints={"전략": "nothing"}), "no_hit": ask(None, own=chunks.limit(0)), "no_product_match": ask(own_bridge=bridge.limit(0)),
        "no_document": ask(states=states("download_failed")), "no_official_document": ask(states=states("unavailable")), "unresolved_product_scope": ask(nobody), "policy": ask(None, own=text, documents=docs, question="ASIA의 정책 구조와 자금조달"),
        "no_policy": ask(None, own=text, documents=docs, question="Nobody의 정책 구조와 자금조달"), "unavailable": ask(own=None),
    })


@query("SELECT 'orders' AS dataset, CAST(count(*) AS VARCHAR) AS n, 'invalid' AS other FROM orders WHERE o_totalprice > 400000")
def request_record(spark, d):
    """The final record of a request of which a part can't be answered."""
    intent = {"product_domain": [{"domain": "orders"}, {"domain": "parts"}], "conditions": [{"attribute": "total", "operator": "gt", "value": "400000", "domain": "orders"}, {"attribute": "type", "operator": "eq", "value": "NONE", "domain": "parts"}]}
    out = _engine(spark, d).answer(intent, "how many?", TODAY, "q1")
    record = json.loads(out.record)
    lines = dict(line.split(" · ")[::2] for line in record["retrieved_context"].split("\n"))
    known = record["question_id"] == "q1" and out.abstained[0].startswith("tables_parts: invalid") and out.abstained[0] in record["answer"]
    return spark.createDataFrame([("orders", lines["orders"], lines["parts"] if known else "lost")], "dataset string, n string, other string")


# --- planning


@query("""
SELECT * FROM (VALUES ('chain', 0, 'graph_c'), ('chain', 1, 'tables_국내ETF'), ('chain', 1, 'tables_해외ETF'), ('chain', 2, 'vectors'), ('one', 0, 'graph_r'), ('one', 0, 'tables_채권'), ('one', 1, 'tables_국내ETF'), ('lookup', 0, 'lookup_p'), ('lookup', 1, 'graph_p'), ('lookup', 2, 'tables_펀드'),
  ('policy', 0, 'vector_policy'), ('theme', 0, 'graph_RT1'), ('theme', 1, 'tables_국내ETF'), ('word', 0, 'graph_RG1'), ('word', 1, 'tables_국내ETF')) p(item, wave, step)
""")
def plan_waves(spark, d):
    """Which steps run, and in which round."""
    etfs = [{"domain": "국내ETF"}, {"domain": "해외ETF"}]
    intents = {
        "chain": ({"product_domain": etfs, "relations": [{"id": "c", "relation": "holds", "object_ref": "a", "subject_domain": "etf"}, {"id": "a", "relation": "subsidiary_of", "object_entity": "X", "entity_role": "company"}], "output_requirements": {"narrative_topics": ["전략"]}}, ""),
        "one": ({"product_domain": [{"domain": "국내ETF"}, {"domain": "채권"}], "relations": [{"id": "r", "relation": "holds", "object_entity": "X", "subject_domain": "국내ETF"}]}, ""),
        "lookup": ({"product_domain": [{"domain": "펀드"}], "relations": [{"id": "p", "relation": "holds", "object_entity": "Y", "entity_role": "product", "subject_domain": "fund"}]}, ""),
        "policy": ({"product_domain": etfs}, "국민성장펀드의 정책 구조와 운용주체"), "theme": ({"product_domain": etfs[:1]}, "반도체 테마 국내ETF"),
        "word": ({"product_domain": etfs[:1], "conditions": [{"attribute": "편입", "operator": "eq", "value": "X", "domain": "국내ETF"}]}, ""),
    }
    rows = [(k, i, s) for k, (intent, question) in intents.items() for i, wave in enumerate(planner.waves(planner.plan(intent, TODAY, question).steps)) for s in wave]
    return spark.createDataFrame(rows, "item string, wave int, step string")


@query(_values(cycle="RequestError", missing="RequestError", repeated="RequestError", merged="tables_국내ETF tables_펀드", currencies="", alternatives="graph_a graph_c", terminal="c", company="", custodian="", etf="국내ETF 해외ETF", bond="채권", anything="채권 국내ETF", year="the year 2026 is not over", object="relation x has no object", issuer="relation x: a theme issues nothing", repaired="gte AUM", domains="국내ETF:레버리지,액티브", entities="A,B", rows="6"))
def plan_decisions(spark, d):
    """Order of relations, whom they restrict, what is ranked together, what stops a request."""
    chain = [{"id": "a", "relation": "holds", "object_entity": "X"}, {"id": "b", "relation": "subsidiary_of", "object_entity": "X"}, {"id": "c", "relation": "holds", "object_ref": "b"}]
    to = lambda subject, domains: " ".join(planner.targets({"subject_domain": subject}, domains))
    both = [{"domain": "국내ETF"}, {"domain": "펀드"}]
    ranked = lambda domains, by: " ".join(planner.plan({"product_domain": domains, "sort": {"attribute": by, "order": "desc", "limit": 5}}, TODAY).merged)
    stops = lambda **x: planner.blockers(x, TODAY)[0].replace("isn't", "is not")
    fixed = planner.repaired({"conditions": [{"attribute": " AUM ", "operator": "이상", "value": "1"}]})["conditions"][0]
    found = planner.domains_of({"product_domain": [{"domain": "국내ETF", "subtype": "레버리지"}, {"domain": "국내ETF", "subtype": ["액티브"]}]})
    return _cases(spark, {
        "cycle": _error(lambda: planner.relation_order([{"id": "a", "object_ref": "b"}, {"id": "b", "object_ref": "a"}])), "missing": _error(lambda: planner.relation_order([{"id": "a", "object_ref": "z"}])), "repeated": _error(lambda: planner.relation_order(chain[:1] * 2)),
        "merged": ranked(both, "1년수익률"), "currencies": ranked([*both, {"domain": "해외ETF"}], "순자산"), "alternatives": " ".join(planner.plan({"product_domain": both, "relations": chain, "any_relation": True}, TODAY).alternatives[0]),
        "terminal": " ".join(r["id"] for r in planner.terminal_relations(chain[1:])[0]), "company": to("기업", ["채권"]), "custodian": to("custodian", ["펀드"]), "etf": to("ETF", ["국내ETF", "해외ETF", "펀드"]), "bond": to("bond", ["채권", "펀드"]), "anything": to("", ["채권", "국내ETF"]),
        "year": stops(full_years=[2026]), "object": stops(relations=[{"id": "x"}]), "issuer": stops(relations=[{"id": "x", "object_entity": "E", "relation": "발행", "entity_role": "theme"}]),
        "repaired": f"{fixed['operator']} {fixed['attribute']}", "domains": ";".join(f"{k}:{','.join(x)}" for k, x in found.items()), "entities": ",".join(planner.entities_of({"target_entities": ["A", {"surface_form": "B", "domain": "펀드"}, {"surface_form": "C", "domain": "채권"}]}, "펀드")), "rows": rows_shown(3),
    })


@query(_values(compare="AA- gte;3년 lte", classes="A C-e", years="2025", window="2026-05-24", any="True", market="True", regions="미국", fields="보수", theme="tagged_with 반도체", issuer="발행사 SK", home="국내ETF", scope="국내ETF 펀드", twice="0", alias="상품명"))
def intent_guards(spark, d):
    """What a question's own words settle, and what is put right in an intent."""
    from lattica.plans.guards import guarded

    restored = wording.restored({"product_domain": [{"domain": "국내ETF"}]}, "미국 주식에 투자하는 국내ETF의 보수율을 알려줘", TODAY)
    bond = {"product_domain": [{"domain": "채권"}], "target_entities": [{"surface_form": "SK", "entity_type": "company"}], "relations": [{"id": "r", "relation": "발행", "object_entity": "SK", "path": ["Company", "채권"]}]}
    held = {"id": "r", "relation": "보유", "object_entity": "SK", "subject_domain": "company", "path": ["Company", "ETF"]}
    return _cases(spark, {
        "compare": ";".join(" ".join(x) for x in wording.comparators("AA- 이상, 3년 이하")), "classes": " ".join(wording.classes("Class A와 종류 C-e")), "years": " ".join(map(str, wording.full_years("2025년 연간"))), "window": wording.window("최근 3개월", TODAY)[0],
        "any": wording.any_relation("SK 및 자회사"), "market": wording.cross_market("같은 펀드와 ETF"), "regions": restored["conditions"][0]["value"], "fields": " ".join(restored["output_requirements"]["fields"]),
        "theme": " ".join(guarded({"product_domain": [{"domain": "국내ETF"}]}, "반도체 테마 ETF")[0]["relations"][0][k] for k in ("relation", "object_entity")), "issuer": " ".join(guarded(bond)[0]["conditions"][0][k] for k in ("attribute", "value")),
        "home": guarded({"product_domain": [{"domain": "해외ETF"}], "relations": [{"id": "r", "relation": "holds", "object_entity": "SK"}]}, "SK를 보유한 ETF")[0]["product_domain"][0]["domain"],
        "scope": " ".join(r["subject_domain"] for r in guarded({"product_domain": [{"domain": "국내ETF"}, {"domain": "펀드"}], "relations": [held]})[0]["relations"]),
        "twice": len(guarded({"product_domain": [{"domain": "국내ETF"}], "conditions": [{"attribute": "테마", "value": "반도체"}], "relations": [{"id": "r", "relation": "tagged_with", "object_entity": "반도체", "entity_role": "theme"}]})[0]["conditions"]),
        "alias": " ".join(guarded({"product_domain": [{"domain": "국내ETF"}], "output_requirements": {"fields": ["ETF명", "국내ETF", ""]}})[0]["output_requirements"]["fields"]),
    })


@query(_values(empty_value="RequestError", unknown_category="RequestError", text_range="RequestError", text_sort="RequestError", unknown_kind="RequestError", view_filter="RequestError", view_unknown="RequestError", bad_limit="RequestError", off_scale="RequestError", open_range="RequestError", no_name="RequestError", no_such_concept="RequestError", empty_vector="RequestError", many_queries="RequestError", named_kind="ok", too_many="Truncated", all_named="3", left_out="not shown", no_label="ok", two_labels="RequestError", lineage="o_totalprice orders.o_totalprice", dated="출처기준일(o_orderdate)"))
def request_errors(spark, d):
    """What fails closed, and what only leaves a note."""
    from dataclasses import replace

    c = Compiler(CATALOG, {n: table(spark, d, n) for n in TABLES})
    on = lambda attribute, operator, value, domain="orders", **more: _error(lambda: c.compile({"domain": domain, "conditions": [{"attribute": attribute, "operator": operator, "value": value}], **more}))
    orders = CATALOG["orders"]
    viewed = Catalog([replace(orders, views={"v": OutputView("raw_rating", ("o_orderpriority",))}, attributes={**orders.attributes, "price": replace(orders.attributes["price"], as_of=("o_orderdate",))})])
    ttl = "@prefix fp: <http://example.org/fx#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . fp:Kind a owl:Class . fp:a a fp:Kind ; rdfs:label \"BUILDING\" . fp:b a fp:Kind ; rdfs:label \"BUILDING\" ."
    typed = Compiler(Catalog([replace(orders, views={"v": OutputView("classification", axes=(("c_mktsegment", "Kind"),))})]), c.tables, ontology=Ontology(parse(ttl), NAMESPACE))
    label = lambda x: _error(lambda: typed.compile({"domain": "orders", "conditions": [{"attribute": "segment", "operator": "eq", "value": x}]}))
    made = Compiler(viewed, c.tables).compile({"domain": "orders", "conditions": [{"attribute": "price", "operator": "gt", "value": "1"}]})
    about = next(x for x in made.lineage if x["key"] == TESTED.format("price"))
    io.register({"raw.cases": table(spark, d, "part")})
    try:
        several = c.compile({"domain": "orders", "conditions": [{"attribute": "colour", "value": "x"}, {"attribute": "priority", "value": " "}], "sort": {"attribute": "segment"}}) and ""
    except RequestError as e:
        several = str(e)
    return _cases(spark, {
        "empty_value": on("priority", "eq", " "), "unknown_category": on("segment", "eq", "NONE"), "text_range": on("customer", "gt", "a"), "text_sort": _error(lambda: c.compile({"domain": "orders", "sort": {"attribute": "segment"}})), "unknown_kind": _error(lambda: c.compile({"domain": "parts", "subtypes": ["none"]})),
        "view_filter": _error(lambda: Compiler(viewed, c.tables).compile({"domain": "orders", "conditions": [{"attribute": "v", "operator": "eq", "value": "x"}]})), "view_unknown": _error(lambda: views.derive(table(spark, d, "part"), "x", OutputView("none"))), "bad_limit": _error(lambda: literals.row_limit("0")),
        "off_scale": on("priority", "gte", "6-NEVER"), "open_range": on("price", "between", "1"), "no_name": _error(lambda: c.compile({"domain": "parts", "entity": " "})), "no_such_concept": on("colour", "eq", "red"), "empty_vector": _error(lambda: vector.top_k(table(spark, d, "embeddings"), [], 5)),
        "many_queries": _error(lambda: vector.search(table(spark, d, "embeddings"), [[1.0]] * 4, 5)), "named_kind": _error(lambda: c.compile({"domain": "parts", "subtypes": ["none"], "entity": "red"})), "too_many": _error(lambda: io.run_sql(spark, "SELECT * FROM raw_cases", most=3)),
        "all_named": len(several.split("; ")), "left_out": c.compile({"domain": "orders", "fields": ["colour"]}).notes[0].partition(":")[0], "no_label": label("MACHINERY"), "two_labels": label("BUILDING"), "lineage": f"o_totalprice {about['column']}", "dated": next(x["key"] for x in made.lineage if x["key"].startswith("출처")),
    })


# --- the graph


@query(_values(plan="", no_class="no class", wrong_seed="the seed is not", limit="the limit is", unlinked="not linked", datatype="is a datatype", free="not a free name", empty_values="has no values", outside="outside the fragment", asked="2", cleaned="my_node seed", roles="Company Security Organization", code="organizationName corpCode", below="ETF Product PublicFund", hits="ETF", sources="fp:productCode orders o_orderkey", reviewed="cambricon 5", ready="subsidiary_holders", union="ETF PublicFund", ancestors="ETF Product", compact="fp:ETF", range="Holding"))
def graph_decisions(spark, d):
    """Plans are checked against the ontology and the data before they run; every problem is named."""
    g = fixture_graph(spark, d)
    o, seed = g.ontology, graph.Entity("resolved", "nation/7-", "Company")
    wrong = lambda plan, part, fragment=None: part if any(part in p for p in g.problems(plan, seed, fragment)) else "missed"
    out = (graph.Output("seed", "organizationName", "name"),)
    asked: list = []

    def generator(problems):
        asked.append(problems)
        return graph.subsidiaries() if problems else graph.Plan({"seed": "Company", "x": "Nothing"}, (), out)

    fragment = o.fragment("Company", ["fp:Company", "fp:SubsidiaryRelation"], hops=3)
    graph.generated_plan(g, seed, fragment, generator)
    clean = graph.cleaned(graph.Plan({"seed": "Company", "my node": "Company"}, (), out))
    name = lambda uris: " ".join(sorted(u.rpartition("#")[2] for u in uris))
    return _cases(spark, {
        "plan": "; ".join(g.problems(HOLDERS, seed)), "no_class": wrong(graph.Plan({"seed": "Nothing"}, (), out), "no class"), "wrong_seed": wrong(graph.Plan({"seed": "ETF"}, (), (graph.Output("seed", "productCode", "c"),)), "the seed is not"),
        "limit": wrong(graph.Plan({"seed": "Company"}, (), out, 501), "the limit is"), "unlinked": wrong(graph.Plan({"seed": "Company", "a": "ETF"}, (), out), "not linked"), "datatype": wrong(graph.Plan({"seed": "Company", "a": "ETF"}, (graph.Edge("seed", "weight", "a"),), out), "is a datatype"),
        "free": wrong(graph.Plan({"seed": "Company"}, (), (*out, *out)), "not a free name"), "empty_values": wrong(graph.Plan({"seed": "Company"}, (), (graph.Output("seed", "ceoName", "c"),)), "has no values"), "outside": wrong(graph.subsidiaries(), "outside the fragment", o.fragment("Theme", ["fp:Theme"], hops=1)),
        "asked": len(asked), "cleaned": " ".join(sorted(clean.nodes)), "roles": " ".join(graph.ROLES["company"]), "code": " ".join(g.names("Company")), "below": name(x for c in ("Product",) for x in g.below(c)), "hits": name([o.class_hits("which ETF")[0][0]]),
        "sources": " ".join(g.sources(HOLDERS)[0]), "reviewed": f"{graph.reviewed_security('Cambricon')[0]} {len(graph.reviewed_security('Cambricon')[1])}", "ready": next(n for n in ("holders", "subsidiary_holders") if graph.ready_plan(["자회사", "편입"], "국내ETF") == getattr(graph, n)(100)),
        "union": name(o.properties[NAMESPACE + "hasHolding"].domains), "ancestors": name(o.ancestors(NAMESPACE + "ETF")), "compact": o.compact(NAMESPACE + "ETF"), "range": name(o.properties[NAMESPACE + "hasHolding"].ranges),
    })


@query("""
SELECT item, CAST(n AS BIGINT) AS n FROM (SELECT 'triples' AS item, (SELECT 2 * count(DISTINCT h) + count(DISTINCT (h, l_extendedprice)) + count(DISTINCT (h, strftime(l_shipdate, '%Y-%m-%d'))) + count(DISTINCT (h, l_linestatus)) FROM (SELECT *, (l_orderkey, l_partkey, l_suppkey, l_linenumber) AS h FROM lineitem)) + 3 * (SELECT count(*) FROM orders) + 3 * (SELECT count(*) FROM supplier) + 4 * (SELECT count(*) FROM nation) + 3 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM nation WHERE n_nationkey % 4 > 0) + 2 * (SELECT count(*) FROM region)
  + (SELECT sum(len(list_distinct(string_split(p_name, ' ')))) + 2 * count(*) FROM part) + 2 * (SELECT count(DISTINCT w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)) AS n
UNION ALL SELECT 'members', count(*) FROM orders
UNION ALL SELECT 'exists', 1 UNION ALL SELECT 'not there', 0
UNION ALL SELECT 'codes', (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 7)
UNION ALL SELECT 'rows over the limit', (SELECT greatest(count(*) - 500, 0) FROM (SELECT DISTINCT l_orderkey, o_orderpriority, l_extendedprice, day, status FROM (
    SELECT *, (l_orderkey, l_partkey, l_suppkey, l_linenumber) AS h, count(l_shipdate) OVER (PARTITION BY h) AS days, max(strftime(l_shipdate, '%Y-%m-%d')) FILTER (strftime(l_shipdate, '%Y-%m-%d') <= '2030-01-01') OVER (PARTITION BY h) AS day, max(l_linestatus) OVER (PARTITION BY h) AS status FROM lineitem)
  JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE s_nationkey = 7 AND o_orderpriority IS NOT NULL AND (days = 0 OR day IS NOT NULL)))
UNION ALL SELECT 'securities', (SELECT count(*) FROM supplier)
UNION ALL SELECT 'ambiguous', 21 UNION ALL SELECT 'unfiltered partitions', 1)
""")
def graph_counts(spark, d):
    """Counts, existence, handed-on codes, a cut that shows, ambiguity; a predicate's filter prunes the store to its partition."""
    g = fixture_graph(spark, d)
    seed = g.resolve("NATION_7", "Company")
    rows = graph.kept(g.run(HOLDERS, seed, cutoff="2030-01-01", capped=False)[0])
    shown = min(g.cut(HOLDERS, rows).count(), HOLDERS.limit)
    scan = g.edges("weight")._jdf.queryExecution().sparkPlan().toString()
    many = spark.range(40).select(F.concat(F.lit("n"), "id").alias("s"), F.lit(graph.TYPE).alias("p"), F.lit(NAMESPACE + "Theme").alias("o")).union(spark.range(40).select(F.concat(F.lit("n"), "id").alias("s"), F.lit(NAMESPACE + "themeName").alias("p"), F.lit("one").alias("o")))
    ambiguous = len(graph.Graph(many, g.ontology).resolve("one", "Theme").candidates) + 1
    cases = {
        "triples": g.count(), "members": g.members("ETF").count(), "exists": int(g.exists("nation/7-", "Company")), "not there": int(g.exists("nation/7-", "ETF")), "codes": g.codes(HOLDERS, rows).distinct().count(),
        "rows over the limit": rows.count() - shown, "securities": g.members("Security").count(), "ambiguous": ambiguous, "unfiltered partitions": scan.count("PartitionFilters: [isnotnull(p#"),
    }
    return spark.createDataFrame(list(cases.items()), "item string, n bigint")


@query("""
SELECT r_name AS name, level, CASE WHEN level = 'segment' THEN 'theme/' || r_name ELSE 'region/' || r_regionkey || '-' END AS uri FROM region, (VALUES ('exact'), ('organisation'), ('key'), ('segment')) l(level)
""")
def resolution_ladder(spark, d):
    """Each level of the ladder over the names of a store, all texts in one plan: equal, organisation form, key, segment."""
    g = fixture_graph(spark, d)
    names = [r.r_name for r in table(spark, d, "region").orderBy("r_regionkey").collect()]  # five regions
    themes = spark.createDataFrame([(f"theme/{n}", p, x) for n in names for p, x in ((graph.TYPE, NAMESPACE + "Theme"), (NAMESPACE + "themeName", f"all/{n} x/more"))], "s string, p string, o string")
    forms = [lambda n: n, lambda n: f"주식회사 {n[:2]}·{n[2:]}", lambda n: f"{n.lower()[:3]}_{n.lower()[3:]}"]
    companies = g.resolved([(3 * i + k, f(n), "Company") for i, n in enumerate(names) for k, f in enumerate(forms)])
    found = companies.unionByName(Graph(themes, g.ontology).resolved([(100 + 3 * i, f"{n}x", "Theme") for i, n in enumerate(names)]))
    name = F.element_at(F.array(*map(F.lit, names)), (F.floor(F.col("number") % 100 / 3) + 1).cast("int"))
    level = F.when((F.col("level") == "organisation") & (F.col("number") % 3 == 2), "key").otherwise(F.col("level"))  # a key's form is an organisation's too
    return found.select(name.alias("name"), level.alias("level"), "uri")


@query("""
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS etf_code, s_name AS security_code FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey IN (1, 2)
""")
def holders_by_reviewed_codes(spark, d):
    """Holders of a security that is known under several codes."""
    return fixture_graph(spark, d).holders_of(("Supplier#000000001", "Supplier#000000002"))


# --- functions


@query(r"""
SELECT p_partkey, lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS display, upper('SK' || regexp_replace(p_name, '[\s·,._\-]+', '', 'g')) AS organisation, replace(p_name, ' ', '/') = 'red/widget' OR replace(p_name, ' ', '/') LIKE 'red/%' OR replace(p_name, ' ', '/') LIKE '%/red' AS has_red,
  'x:' || p_partkey AS compact, 'http://x/y#' || p_partkey AS expanded, p_size % 2 = 0 AS in_class, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END AS shown, 'a\\' || p_size || '\n' AS escaped, length(p_name) AS n
FROM part
""")
def name_functions(spark, d):
    p = table(spark, d, "part")
    uri = F.concat(F.lit("http://x/y#"), "p_partkey")
    prefixes = {"x": "http://x/y#", "z": "http://x/"}
    return p.select(
        "p_partkey", t.display_key(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "))).alias("display"), t.organisation_key(F.concat(F.lit("주식회사 에스케이 "), "p_name", F.lit("㈜"))).alias("organisation"), t.has_segment(F.replace("p_name", F.lit(" "), F.lit("/")), "Red").alias("has_red"),
        t.compact(uri, prefixes).alias("compact"), t.expand(F.concat(F.lit("x:"), "p_partkey"), prefixes).alias("expanded"), t.ends_in_class(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " 종류C-e").otherwise(" Class C")), "C-e").alias("in_class"),
        evidence.shown_value(F.col("p_size") % 2 == 0, "boolean").alias("shown"), evidence.shown_value(F.concat(F.lit("a\\"), "p_size", F.lit("\n")), "string").alias("escaped"), F.length(t.public_label(F.concat("p_name", F.lit(" (p_name)")))).cast("long").alias("n"),
    )


@query(r"""
SELECT doc_id, substr(array_to_string(list_slice(regexp_split_to_array(trim(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), 1, 25), ' '), 1, 240) AS quote, substr(text, 1, 400) AS cut FROM documents
""")
def excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", t.excerpt(F.coalesce("text", F.lit(""))).alias("quote"), F.substring("text", 1, 400).alias("cut"))


@query("""
SELECT n_nationkey, CAST((n_nationkey + 1) * 1000000000000.0 AS DOUBLE) AS won, CAST(n_nationkey * 365 AS DOUBLE) AS days, CAST(n_nationkey AS DOUBLE) / 10 AS percent, CAST((n_nationkey + 1) * 100000000.0 AS DOUBLE) AS dollars, '2024' || lpad(CAST(n_nationkey % 12 + 1 AS VARCHAR), 2, '0') || '05' AS day,
  strftime(DATE '2026-08-24' - to_months(CAST(n_nationkey + 1 AS INTEGER)), '%Y-%m-%d') AS since, 2010 + n_nationkey >= 2026 AS unfinished, n_nationkey + 1 AS top FROM nation
""")
def request_literals(spark, d):
    """Values of requests with units, days, windows and limits, one set a nation."""
    out = []
    for k in sorted(r.n_nationkey for r in table(spark, d, "nation").select("n_nationkey").collect()):  # 25 nations
        numbers = literals.number(f"{k + 1}조원", "won"), literals.number(f"{k}년", "days"), literals.number(f"{k / 10} %", "percent"), literals.number(f"{k + 1}억 달러", "dollar")
        out.append((k, *map(float, numbers), literals.day(f"2024-{k % 12 + 1:02}-05"), literals.months_back(TODAY, k + 1)[0].isoformat(), literals.unfinished_year(2010 + k, TODAY), literals.row_limit(f"top {k + 1}개")))
    return spark.createDataFrame(out, "n_nationkey int, won double, days double, percent double, dollars double, day string, since string, unfinished boolean, top int")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'SK' ELSE 'sk' END || '하이닉스' AS variant, CASE WHEN c_custkey % 3 = 0 THEN 'invalid' WHEN c_custkey % 3 = 1 THEN 'available' ELSE 'null' END AS status, c_custkey % 3 <> 0 AS finite FROM customer
""")
def number_states(spark, d):
    """Infinite and missing numbers are told apart; names of organisations with their letters spelled out."""
    c = table(spark, d, "customer")
    x = F.when(F.col("c_custkey") % 3 == 0, F.lit(float("inf"))).when(F.col("c_custkey") % 3 == 1, F.col("c_acctbal"))
    spelled = t.organisation_variants("에스케이하이닉스")
    return c.select("c_custkey", F.when(F.col("c_acctbal") < 0, spelled[1]).otherwise(F.replace(F.lit(spelled[1]), F.lit("SK"), F.lit("sk"))).alias("variant"), evidence.field_status(x, "double").alias("status"), v.finite(F.coalesce(x, F.lit(0.0))).alias("finite"))


# --- views, evidence, scores


@query("""
SELECT c_custkey, 'derivation_unavailable' AS unsupported, 'C < A' AS scale, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS raw, CASE WHEN c_custkey % 2 = 0 THEN 'available' ELSE 'null' END AS raw_status, 'name=' || c_name || ', segment=' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '값 미확보' END AS keys,
  CASE WHEN c_custkey % 5 = 0 THEN 'A' END AS class, CASE WHEN c_custkey % 5 = 0 THEN 'available' ELSE 'null' END AS class_status, 'not_selected' AS gone, CASE WHEN c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING' THEN 'BUILDING (fx:b)' END AS rating, CASE WHEN c_custkey % 2 = 1 THEN 'null' WHEN c_mktsegment = 'BUILDING' THEN 'available' ELSE 'unresolved' END AS rating_status
FROM customer
""")
def output_views(spark, d):
    """Derived fields with their own statuses: unsupported, scale, stored value, keys, class, a column that isn't there, a rating's individual."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"), F.concat("c_name", F.when(F.col("c_custkey") % 5 == 0, " Class A").otherwise("")).alias("title"))
    labels = spark.createDataFrame([("CreditRating", "BUILDING", "fx:b"), ("CreditRating", "MACHINERY", "fx:m"), ("CreditRating", "MACHINERY", "fx:n"), ("Other", "FURNITURE", "fx:f")], "axis string, label string, uri string")
    rows = c
    for name, view, scale in (("u", OutputView("unsupported", reason="why"), None), ("o", OutputView("rating_order"), ["C", "A"]), ("r", OutputView("raw_rating", ("segment",)), None), ("k", OutputView("identity_keys", ("name", "segment", "zz")), None), ("c", OutputView("share_class", ("title",)), None), ("g", OutputView("raw_rating", ("zz",)), None), ("i", OutputView("rating", ("segment",)), None)):
        rows = views.derive(rows, name, view, scale, labels, "c_custkey")
    return rows.select("c_custkey", F.col("u.status").alias("unsupported"), F.col("o.value").alias("scale"), F.col("r.value").alias("raw"), F.col("r.status").alias("raw_status"), F.col("k.value").alias("keys"), F.col("c.value").alias("class"), F.col("c.status").alias("class_status"), F.col("g.status").alias("gone"), F.col("i.value").alias("rating"), F.col("i.status").alias("rating_status"))


@query("""
SELECT c_custkey, 'name: ' || c_name || chr(10) || 'nation: ' || CASE WHEN c_nationkey = 0 THEN '(zero_unavailable)' ELSE c_nationkey || ' no.' END AS text FROM customer
""")
def rendered_contract(spark, d):
    """The fields of a row as lines of text, statuses where there is no value."""
    c = table(spark, d, "customer")
    fields = [{"field": "nation (c_nationkey)", "column": "c_nationkey", "rule": "0 = 값 없음", "unit": "no."}, {"field": "name", "column": "c_name"}]
    return evidence.rendered(evidence.contract(c, "c_custkey", fields), "c_custkey")


@query("""
SELECT vec_id AS chunk_id, coalesce((SELECT r_name FROM region WHERE r_regionkey = vec_id), '') AS title, label FROM embeddings
""")
def chunk_documents(spark, d):
    """Chunks with what is known of their documents; texts are never null."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), "label", F.lit(0.0).alias("score"))
    documents = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("document_id"), F.col("r_name").alias("title"))
    return vector.normalised(vector.with_documents(e, documents), ["title"]).select("chunk_id", "title", "label")


@query("""
SELECT chunk_id, CAST(greatest(least(80, 240 - 80 * (n - 1)), 0) AS INTEGER) AS quoted FROM (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) AS n FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2))
""")
def quotes_by_budget(spark, d):
    """Quotes share their document's budget of characters, best hits first."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("score"))
    hits = line.select(F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), "score", F.repeat(F.lit("x"), 80).alias("text"))
    return vector.quotes(hits, "text").select("chunk_id", F.length("quote").alias("quoted"))


@query("SELECT count(*) AS retrieved, 20 AS displayed, count(*) >= 100 AS truncated FROM (SELECT * FROM part LIMIT 100)")
def step_counters(spark, d):
    found = evidence.counters(table(spark, d, "part"), 100, 20)
    return spark.createDataFrame([(found["retrieved_rows"], found["displayed_rows"], found["coverage_truncated"])], "retrieved bigint, displayed int, truncated boolean")


# --- sources


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lattica-source-{uuid.uuid4().hex}"


@query("SELECT n_nationkey AS code, n_name AS name FROM nation WHERE n_regionkey = 2")
def guarded_sql(spark, d):
    """A reading statement with values as parameters over registered views."""
    io.register({"raw.nations": table(spark, d, "nation")})
    return io.run_sql(spark, "SELECT n_nationkey AS code, n_name AS name FROM raw_nations WHERE n_regionkey = :region", {"region": 2})


@query(_values(select="ok", columns="ok", cte="ok", text="ok", insert="RequestError", cte_insert="RequestError", two="RequestError", drop="RequestError", explain="RequestError", update="RequestError", create="RequestError", cache="RequestError", broken="RequestError", graph="ok", graph_insert="RequestError", graph_service="RequestError", graph_construct="RequestError"))
def reading_only(spark, d):
    """Which statements are run: Spark's parser decides, names of columns don't matter."""
    sql = {"select": "SELECT 1", "columns": "SELECT set, load, use, cache FROM t", "cte": "WITH a AS (SELECT 1) SELECT * FROM a", "text": "SELECT 'drop table x' -- delete", "insert": "INSERT INTO t VALUES (1)", "cte_insert": "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "two": "SELECT 1; SELECT 2",
           "drop": "DROP TABLE t", "explain": "EXPLAIN DROP TABLE t", "update": "UPDATE t SET a = 1", "create": "CREATE TABLE t AS SELECT 1", "cache": "CACHE TABLE t", "broken": "SELEC 1"}
    sparql = {"graph": "SELECT ?a WHERE { ?a ?b ?c }", "graph_insert": "INSERT DATA { <a> <b> <c> }", "graph_service": "SELECT * { SERVICE <http://x> { ?a ?b ?c } }", "graph_construct": "CONSTRUCT { ?a ?b ?c } WHERE { ?a ?b ?c }"}
    return _cases(spark, {k: _error(lambda x=x: io.assert_reading(x, spark)) for k, x in sql.items()} | {k: _error(lambda x=x: io.assert_reading_graph(x)) for k, x in sparql.items()})


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation")
def csv_source(spark, d):
    """Companies written as CSV and read back."""
    path = _place(spark)
    table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).write.csv(path, header=True)
    return io.read_companies(spark, path).select(F.col("k").cast("int").alias("k"), "name", F.col("region").cast("int").alias("region"))


@query("SELECT 'T' || n_nationkey AS ticker, n_name AS name, 'doc ' || n_regionkey AS document FROM nation")
def sidecar_source(spark, d):
    """Provenance documents from a JSON object of entries; a file that isn't there is an empty table."""
    path = _place(spark)
    rows = table(spark, d, "nation").select(F.concat(F.lit("T"), "n_nationkey").alias("ticker"), F.col("n_name").alias("name"), F.concat(F.lit("doc "), "n_regionkey").alias("document"))
    keyed = rows.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("ticker", F.struct("ticker", "name", "document")))).alias("entries"))  # 25 nations
    keyed.select(F.to_json(F.struct("entries"))).coalesce(1).write.text(path)
    return io.read_sidecar(spark, path).select("ticker", "name", "document").unionByName(io.read_sidecar(spark, path + "-none").select("ticker", "name", "document"))


@query("SELECT 'http://x/n' || n_nationkey AS s, n_name AS o FROM nation")
def turtle_source(spark, d):
    """Turtle text of a table, parsed into triples, stored by predicate and read back by one predicate."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 nations
    ttl = "@prefix x: <http://x/> .\n" + "\n".join(f'x:n{r.n_nationkey} x:name "{r.n_name}" ; x:key {r.n_nationkey} .' for r in rows)
    path = _place(spark)
    io.write_triples(io.triples_table(spark, parse(ttl)), path)
    return spark.read.parquet(path).filter("p = 'http://x/name'").select("s", "o")


@query(_values(first="second store", nothing="Unavailable", empty="0", driver="jdbc:postgresql://h:1/d", views="None", retried="2"))
def store_choice(spark, d):
    """The first graph store that opens is asked; an empty one is an answer, none is an error."""
    def gone():
        return spark.read.parquet(_place(spark))

    calls: list = []

    def twice():
        calls.append(1)
        if len(calls) < 2:
            raise ConnectionError("passing")
        return len(calls)

    return _cases(spark, {
        "first": stores.first_available({"a": gone, "b": lambda: "second store"})(), "nothing": _error(stores.first_available({"a": gone})), "empty": stores.first_available({"a": lambda: spark.range(0)})().count(),
        "driver": io.dsn_from_env({"DATABASE_URL": "postgres://u:p@h:1/d"}), "views": io.dsn_from_env({}), "retried": io.with_retries(twice, sleep=lambda s: None),
    })


@query("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type FROM (DESCRIBE SELECT * FROM orders)")
def catalog_snapshot(spark, d):
    """The schema of a registered table by the session's catalog, saved and loaded; a schema that would be cut is refused."""
    io.register({"snap_orders": table(spark, d, "orders")})
    found = io.catalog_snapshot(spark)
    path = _place(spark)
    io.save_snapshot(spark, found, path)
    again = io.load_snapshot(spark, path)
    refused = _error(lambda: io.catalog_snapshot(spark, most=3))
    schema = again["tables"]["snap_orders"] if again == found and refused == "Truncated" and not io.contract_gaps(found, {"snap_orders": {"o_orderkey"}}) else {}
    return spark.createDataFrame(list(schema.items()), "name string, type string")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def answer_sink(spark, d):
    """Rows written as JSON records and read back."""
    path = _place(spark)
    io.write_json(table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus"), path)
    return spark.read.schema("o_orderkey bigint, o_orderstatus string").json(path)


@query("SELECT 'missing: orders.o_gone' AS gap UNION ALL SELECT 'missing: table gone'")
def catalog_gaps(spark, d):
    """All columns and tables that a catalog refers to and the tables lack."""
    from dataclasses import replace

    orders = CATALOG["orders"]
    changed = replace(orders, identity=("o_gone",), enrichments={"customer": replace(orders.enrichments["customer"], table="gone")})
    gaps = Catalog([changed]).missing({"orders": table(spark, d, "orders")})
    return spark.createDataFrame([(f"missing: {g}",) for g in gaps], "gap string")
