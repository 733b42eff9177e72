"""The compiler's rules on small tables with what the star schema lacks: text numbers, marks, nulls, padded names."""

import pytest

from lattica.errors import ContractError, RequestError
from lattica.plans.catalog import Attribute, Catalog, Domain
from lattica.plans.compile import Compiler
from lattica.plans.products import PRODUCTS

ROWS = [
    ("K1", "KODEX 200", "KODEX200", "T1", "1,000", "1", "0", "AAA", "Y", "ETF", "삼성자산운용(주)", "99991231"),
    ("K2", "KODEX 200 인버스", "KOINV", "T2", "n/a", "0", "1", "AA-", "N", "ETF", "케이비자산운용", "20251223.0"),
    ("K3", "TIGER 은행", "TIGER", "T3", None, None, None, None, None, "ETN", "KB자산운용", "0"),
    ("K4", "ACE 100%", "ACE", "T4", "0", "1", "9", "C", "Y", "ETF", "ACE", "20240101"),
]
NAMES = "pd_itm_no pd_nm pd_abrv_nm pd_ticker pd_net_tamt pd_sale_yn pd_tr_yn rating pension pd_grp_no manager ends".split()
DOMAIN = Domain(
    "etf", "raw.etf", "pd_itm_no", "pd_nm", ("pd_nm", "pd_abrv_nm", "pd_itm_no"),
    {
        a.name: a
        for a in (
            Attribute("size", "pd_net_tamt", "numeric", unit="won", zero_missing=True, as_of=("ends", "gone")), Attribute("sale", "pd_sale_yn", "flag", true="1"),
            Attribute("halted", "pd_tr_yn", "boolean", true="1", false="0", false_words=("정상",)), Attribute("rating", "rating", "ordinal", ("C", "AA-", "AAA")), Attribute("pension", "pension", "categorical", ("Y", "N")),
            Attribute("manager", "manager", "text", organisation=True), Attribute("name", "pd_nm"), Attribute("ends", "ends", "date"),
        )
    },
)


@pytest.fixture(scope="module")
def compiler(spark):
    return Compiler(Catalog([DOMAIN]), {"raw.etf": spark.createDataFrame(ROWS, ", ".join(f"{n} string" for n in NAMES))})


def codes(compiler, *conditions, **request):
    keys = ("attribute", "operator", "value", "value_2")
    found = compiler.compile({"domain": "etf", "conditions": [dict(zip(keys, c)) for c in conditions], **request})
    return [r.code for r in found.rows.collect()]


@pytest.mark.parametrize(
    "condition, want",
    [
        (("size", "gte", "1000원"), ["K1"]), (("size", "lt", "1천억원".replace("1천", "천")), ["K1"]), (("sale", "eq", "true"), ["K1", "K4"]), (("sale", "eq", "불가"), ["K2"]),
        (("halted", "eq", "정상"), ["K1"]), (("halted", "ne", "true"), ["K1"]), (("halted", "eq", "참"), ["K2"]), (("pension", "ne", "가능"), ["K2"]), (("rating", "gte", "AA-"), ["K1", "K2"]), (("rating", "gt", "AAA"), []),
        (("manager", "eq", "KB자산운용"), ["K2", "K3"]), (("manager", "eq", "주식회사 삼성자산운용"), ["K1"]), (("manager", "contains", "자산"), ["K1", "K2", "K3"]), (("name", "contains", "0%"), ["K4"]), (("name", "contains", "_"), []),
        (("name", "eq", "ACE 100%"), ["K4"]), (("name", "in", ["ACE 100%", "TIGER 은행"]), ["K3", "K4"]), (("ends", "lte", "2025-12-31"), ["K2", "K3", "K4"]), (("ends", "between", "20240101", "20251231"), ["K2", "K4"]),
    ],
)
def test_predicates(compiler, condition, want):
    assert sorted(codes(compiler, condition)) == want


@pytest.mark.parametrize("condition", [("size", "eq", ""), ("size", "eq", None), ("pension", "eq", "maybe"), ("name", "gt", "a"), ("rating", "eq", "AAAA"), ("size", "like", "1"), ("sale", "gt", "true"), ("size", "between", "1"), ("color", "eq", "x"), ("manager", "ne", "KB"), ("name", "in", "a,,b"), ("halted", "gt", "true")])
def test_what_cannot_be_resolved_is_an_error(compiler, condition):
    with pytest.raises(RequestError):
        codes(compiler, condition)


def test_identity_is_exact_first(compiler):
    assert codes(compiler, entity="kodex 200") == ["K1"]
    assert codes(compiler, entity="KODEX") == ["K1", "K2"]
    assert codes(compiler, entity="KOINV") == ["K2"]


def test_sort_leaves_out_what_has_no_value(compiler):
    assert codes(compiler, sort={"attribute": "size", "order": "desc"}) == ["K1"]
    assert codes(compiler, sort={"attribute": "rating", "order": "desc", "limit": "2개"}) == ["K1", "K2"]
    for bad in ({"attribute": "name"}, {"attribute": "size", "order": "up"}, {"attribute": "size", "limit": 0}):
        with pytest.raises(RequestError):
            codes(compiler, sort=bad)


def test_lineage_and_notes(compiler):
    found = compiler.compile({"domain": "etf", "fields": ["size"], "conditions": [{"attribute": "sale", "operator": "eq", "value": "true"}]})
    assert [x["key"] for x in found.lineage] == ["name", "code", "size", "조건근거(sale)", "출처기준일(ends)"]
    assert found.rows.schema["size"].metadata["column"] == "raw.etf.pd_net_tamt" and any("gone" in n for n in found.notes)


def test_contract(spark, compiler):
    with pytest.raises(ContractError, match="raw.etf.rating"):
        Compiler(compiler.catalog, {"raw.etf": compiler.tables["raw.etf"].drop("rating")}).compile({"domain": "etf"})


def test_descriptions_add_names_but_never_override(spark, compiler):
    described = Compiler(compiler.catalog, compiler.tables, {"etf": {"pd_ticker": "Ticker code", "ends": "size"}})
    assert described.attribute(DOMAIN, "ticker  CODE").column == "pd_ticker"
    assert described.attribute(DOMAIN, "size").column == "pd_net_tamt"


def test_the_product_catalog():
    assert {d: len(PRODUCTS[d].attributes) for d in PRODUCTS.domains} == {"채권": 30, "국내ETF": 36, "해외ETF": 25, "펀드": 33}
    assert {d: len(PRODUCTS[d].subtypes) for d in PRODUCTS.domains} == {"채권": 87, "국내ETF": 10, "해외ETF": 2, "펀드": 14}
    bond = PRODUCTS["채권"]
    assert bond.resolve("쿠폰 금리").column == "srfc_irt" and bond.resolve("신용등급").values[-1] == "AAA"
    assert bond.subtype("특수은행채").column == "bd_knd" and bond.view("만기 구분")[1].kind == "maturity"
    assert PRODUCTS["펀드"].fields("순자산·위험등급") == ["순자산", "위험등급"] and PRODUCTS["펀드"].fields("순자산/없음") == ["순자산/없음"]


def test_a_stream_goes_through_the_same_compiler(spark, compiler, tmp_path):
    from lattica.streaming.requests import compile_stream

    compiler.tables["raw.etf"].write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(compiler.tables["raw.etf"].schema).parquet(str(tmp_path / "in"))
    found = compile_stream(compiler.catalog, stream, {"domain": "etf", "conditions": [{"attribute": "sale", "operator": "eq", "value": "true"}]})
    q = found.rows.writeStream.format("memory").queryName("sold").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.code for r in spark.table("sold").collect()) == ["K1", "K4"]
    with pytest.raises(RequestError):
        compile_stream(compiler.catalog, stream, {"domain": "etf", "entity": "x"})


def test_marks_in_titles(spark):
    names = sorted(PRODUCTS["채권"].columns())
    rows = [tuple({"pd_no": "B1", "pd_nm": "가나 1(녹)"}.get(n) for n in names), tuple({"pd_no": "B2", "pd_nm": "다라 2"}.get(n) for n in names)]
    compiler = Compiler(PRODUCTS, {"raw.prbd01n001": spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))})
    ask = lambda **r: [x.code for x in compiler.compile({"domain": "채권", **r}).rows.collect()]
    assert ask(conditions=[{"attribute": "ESG채권구분", "operator": "eq", "value": "녹색채권"}]) == ["B1"]
    assert ask(subtypes=["녹색채권"]) == ["B1"] and ask(entity="다라2") == ["B2"]
    with pytest.raises(RequestError):
        ask(subtypes=["없는종류"])
