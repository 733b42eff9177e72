"""What a question's own words settle about an intent, without a model: comparators, windows, classes, years, alternatives."""

from __future__ import annotations

import re
from datetime import date

from lattica.functions.literals import months_back

# Words behind a value that compare, and their operators.
COMPARATORS = {"이상": "gte", "이하": "lte", "초과": "gt", "미만": "lt"}
VALUE = r"(?P<value>[A-Z]{1,3}[+-]?0?|[0-9][0-9,.]*\s*(?:%|[가-힣]*원|년|일|개월|배)?)"


def comparators(question: str) -> list[tuple[str, str]]:
    """(value, operator) for each value that a comparing word follows."""
    words = "|".join(COMPARATORS)
    return [(m["value"].replace(" ", ""), COMPARATORS[m["word"]]) for m in re.finditer(rf"{VALUE}\s*(?P<word>{words})", question)]


def with_comparators(conditions: list[dict], question: str) -> list[dict]:
    """Conditions whose operator is the one that the question puts behind their value; others stay."""
    said = {re.sub(r"[\s,]", "", v): op for v, op in comparators(question)}
    return [c | {"operator": said.get(re.sub(r"[\s,]", "", str(c.get("value"))), c.get("operator", "eq"))} for c in conditions]


def window(question: str, today: date) -> tuple[date, date] | None:
    """The days of "the last N months"; None without such words."""
    found = re.search(r"최근\s*([0-9]{1,2})\s*(개월|년)", question)
    return months_back(today, int(found[1]) * (12 if found[2] == "년" else 1)) if found else None


def classes(question: str) -> list[str]:
    """Codes of share classes that are named, each once."""
    found = re.findall(r"(?:Class|클래스|종류)\s*([A-Za-z][A-Za-z0-9-]*)", question, re.IGNORECASE)
    found += re.findall(r"\b([A-Z][A-Za-z0-9]?(?:-[A-Za-z]+)?)\s*클래스", question)
    return list(dict.fromkeys(found))


def full_years(question: str) -> list[int]:
    """Years asked for as a whole."""
    return [int(y) for y in dict.fromkeys(re.findall(r"\b(20[0-9]{2})년\s*(?:연간|전체|한\s*해)", question))]


def any_relation(question: str) -> bool:
    """Whether a company and its subsidiaries are alternatives ("X and its subsidiaries")."""
    return bool(re.search(r"(?:및|와|과|또는)\s*(?:그\s*)?자회사", question))


def cross_market(question: str) -> bool:
    """Whether it is asked if a fund and an ETF are one product."""
    return bool(re.search(r"동일|같은", question)) and "펀드" in question and "ETF" in question.upper()


# Regions as the stored values have them, and the words that ask for exposure to them.
REGIONS = {"미국": "미국", "중국": "중국", "일본": "일본", "인도": "인도", "유럽": "유럽", "베트남": "베트남", "글로벌": "글로벌", "아시아": "아시아"}
EXPOSURE = r"(?:에\s*)?(?:투자하는|투자|노출)"
#: Words that ask for a field, by the field; a domain's own names are looked for too.
OUTPUT_WORDS = {"보수": ("총보수", "보수율", "수수료"), "순자산": ("순자산", "AUM", "규모"), "위험등급": ("위험등급", "위험 등급"), "신용등급": ("신용등급", "신용 등급"), "상장일": ("상장일",), "만기일": ("만기일", "만기가 언제")}


def regions(question: str) -> list[str]:
    """Regions that the question wants exposure to."""
    return [stored for word, stored in REGIONS.items() if re.search(rf"{word}\s*(?:주식|채권|시장)?{EXPOSURE}", question)]


def output_fields(question: str) -> list[str]:
    """Fields that the question asks to be shown."""
    asked = re.search(r"(.*?)(?:알려|보여|함께|비교|얼마|언제|몇)", question, re.S)
    return [f for f, words in OUTPUT_WORDS.items() if asked and any(w in asked[1] for w in words)]


def restored(intent: dict, question: str, today: date) -> dict:
    """The intent with all of this; what it already holds on years, classes, alternatives, regions and fields stays."""
    out = dict(intent)
    if out.get("conditions"):
        out["conditions"] = with_comparators(out["conditions"], question)
    for name, found in (("full_years", full_years(question)), ("class_suffixes", classes(question)), ("any_relation", any_relation(question)), ("window", window(question, today)), ("cross_market", cross_market(question))):
        if found and not out.get(name):
            out[name] = found
    etfs = [d.get("domain") for d in out.get("product_domain", ()) if d.get("domain") == "국내ETF"]
    if etfs and not any(c.get("attribute") == "투자지역" for c in out.get("conditions", ())):
        if found := regions(question):
            out["conditions"] = [*out.get("conditions", ()), {"attribute": "투자지역", "operator": "in" if len(found) > 1 else "eq", "value": found if len(found) > 1 else found[0], "domain": "국내ETF"}]
    if not (out.get("output_requirements") or {}).get("fields") and out.get("product_domain") and (found := output_fields(question)):
        out["output_requirements"] = {**(out.get("output_requirements") or {}), "fields": found}
    return out
