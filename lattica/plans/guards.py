"""What is put right in an intent before it is planned. Each guard takes the intent and the question and gives the intent,
changed only where the words are plain; what it did is noted. Values are never guessed."""

from __future__ import annotations

import re
from collections.abc import Callable

from lattica.functions.text import squeeze

# Words for relations between entities, which no table has as a column.
HOLDS = ("편입", "보유", "holding", "held_by", "holds")
RELATION_OF = {"편입": "holds", "보유": "holds", "포함": "holds", "편입종목": "holds", "자회사": "subsidiary_of", "계열사": "subsidiary_of", "출자": "subsidiary_of"}
ISSUES = ("발행", "issued_by", "issuedby", "issues")
COMPANIES = ("company", "organization", "issuer")
# Other names of fields, words that name a domain and no field, and scopes that aren't themes.
FIELD_OF = {"ETF명": "상품명", "ETN명": "상품명"}
DOMAIN_WORDS = ("채권", "ETF", "ETN", "펀드", "국내ETF", "해외ETF", "상품")
SCOPES = ("국내", "해외", "상장", "주식", "실제", "관련", "편입된", "보유한")
PRODUCT_DOMAINS = ("국내ETF", "해외ETF", "펀드")
THEME = r"([가-힣A-Za-z0-9]+)\s*(?:테마|섹터)"
OVERSEAS = r"해외|미국|글로벌|나스닥|뉴욕|외국"

Guard = Callable[[dict, str], tuple[dict, list[str]]]


def _fresh(intent: dict, stem: str, n: int) -> str:
    """The n-th free id of a kind of relation."""
    taken = {r.get("id") for r in intent.get("relations", ())}
    found = f"{stem}{n}"
    while found in taken:
        n += 1
        found = f"{stem}{n}"
    return found


def _with_relations(intent: dict, stem: str, new: list[dict]) -> dict:
    out = {**intent, "relations": list(intent.get("relations", ()))}
    for r in new:
        out["relations"].append({"id": _fresh(out, stem, 1), **r})
    return out


def plain_fields(intent: dict, question: str) -> tuple[dict, list[str]]:
    """Requested fields and topics: each once, by their usual names, none that only names a domain."""
    wanted, notes = dict(intent.get("output_requirements") or {}), []
    barred = {*DOMAIN_WORDS, *(d.get("domain") for d in intent.get("product_domain", ()))}
    for k in ("fields", "narrative_topics"):
        was = wanted.get(k) or []
        now = list(dict.fromkeys(FIELD_OF.get(x, x) for x in map(str.strip, was) if x and x not in barred))
        if now != was:
            wanted[k] = now
            notes.append(f"{k}: {was} read as {now}")
    return ({**intent, "output_requirements": wanted} if notes else intent), notes


def relations_among_conditions(intent: dict, question: str) -> tuple[dict, list[str]]:
    """Conditions whose attribute is a relation become relations to a company."""
    kept, new = [], []
    for c in intent.get("conditions", ()):
        relation = RELATION_OF.get(str(c.get("attribute", "")).strip())
        if relation and str(c.get("value") or "").strip() and not c.get("applies_to"):
            new.append({"relation": relation, "object_entity": str(c["value"]).strip(), "entity_role": "company", "subject_domain": c.get("domain") or ""})
        else:
            kept.append(c)
    if not new:
        return intent, []
    return _with_relations({**intent, "conditions": kept}, "RG", new), [f"{r['object_entity']}: {r['relation']} is a relation, no column" for r in new]


def themes_in_words(intent: dict, question: str) -> tuple[dict, list[str]]:
    """Themes that the question names ("X theme", or "X <kind> ETF" beside a holding) where no relation holds one."""
    relations = intent.get("relations", [])
    if any(r.get("entity_role") == "theme" for r in relations):
        return intent, []
    domains = [d.get("domain", "") for d in intent.get("product_domain", ())]
    found = {x: domains[0] if domains else "" for x in re.findall(THEME, question)}
    if not found and any(r.get("relation") in HOLDS for r in relations):
        for d in intent.get("product_domain", ()):
            kinds = d.get("subtype") or [] if d.get("domain") == "국내ETF" else []
            for kind in [kinds] if isinstance(kinds, str) else kinds:
                for word in re.findall(rf"(?<![가-힣A-Za-z0-9])([가-힣A-Za-z0-9]+)\s+{re.escape(kind)}\s*(?:ETF|ETN|상장지수)", question, re.I):
                    if word not in SCOPES:
                        found[f"{word} {kind}"] = d["domain"]
    new = [{"relation": "tagged_with", "object_entity": x, "entity_role": "theme", "subject_domain": d} for x, d in found.items()]
    return (_with_relations(intent, "RT", new) if new else intent), [f"{r['object_entity']}: a theme is a relation" for r in new]


def said_once(intent: dict, question: str) -> tuple[dict, list[str]]:
    """Conditions and kinds that only repeat a theme or holding relation, or the sort, go."""
    relations, notes = intent.get("relations", ()), []
    themes = [(r.get("subject_domain", ""), squeeze(r.get("object_entity", ""))) for r in relations if r.get("entity_role") == "theme"]
    held = {r.get("subject_domain") for r in relations if r.get("relation") in HOLDS}
    sort = intent.get("sort") or {}

    def repeats(c: dict) -> bool:
        name, value = squeeze(c.get("attribute", "")), c.get("value")
        if name == "테마" and squeeze(value) in {t for _, t in themes}:
            return True
        if name in ("편입여부", "보유여부") and squeeze(value) in ("true", "1", "y") and c.get("domain") in held:
            return True
        among = sort.get("domains") or []
        return bool(sort.get("attribute")) and c.get("attribute") == sort["attribute"] and not str(value or "").strip() and (not among or c.get("domain") in (None, "", *among))

    kept = [c for c in intent.get("conditions", ()) if not repeats(c)]
    if len(kept) < len(intent.get("conditions", ())):
        notes.append("conditions that a relation or the sort already says are left out")
    domains = []
    for d in intent.get("product_domain", ()):
        kinds = d.get("subtype") or []
        kinds = [kinds] if isinstance(kinds, str) else kinds
        own = [k for k in kinds if not any(squeeze(k) in t for where, t in themes if where == d.get("domain"))]
        notes += [f"{k}: a theme says so already" for k in kinds if k not in own]
        domains.append({**d, "subtype": own} if own != kinds else d)
    return ({**intent, "conditions": kept, "product_domain": domains} if notes else intent), notes


def product_relations(intent: dict, question: str) -> tuple[dict, list[str]]:
    """A company's bonds are a condition on their issuer; a company's holders are asked for in each product domain."""
    domains, notes = [d.get("domain") for d in intent.get("product_domain", ())], []
    companies = {e.get("surface_form") or e.get("name") for e in intent.get("target_entities", ()) if isinstance(e, dict) and str(e.get("entity_type", "")).casefold() in COMPANIES}
    referred = {r.get("object_ref") for r in intent.get("relations", ())}
    out = {**intent, "relations": [], "conditions": list(intent.get("conditions", ()))}
    for r in intent.get("relations", ()):
        said, path, name = str(r.get("relation", "")).casefold(), squeeze(" ".join(map(str, r.get("path") or ()))), r.get("object_entity")
        alone = not r.get("object_ref") and r.get("id") not in referred
        if said in ISSUES and name in companies and "채권" in domains and ("채권" in path or "bond" in path) and alone:
            if not any(c.get("domain") == "채권" and c.get("attribute") in ("발행사", "발행기관") and c.get("value") == name for c in out["conditions"]):
                out["conditions"].append({"domain": "채권", "attribute": "발행사", "operator": "eq", "value": name})
            notes.append(f"{name}: bonds are looked up by their issuer")
            continue
        if said in HOLDS:
            r = {**r, "relation": "holds"} | ({"entity_role": "company"} if name in companies else {})
            wanted = [d for d in domains if d in PRODUCT_DOMAINS]
            if squeeze(r.get("subject_domain", "")) in ("company", "기업", "회사") and re.search("상품|product|etf|펀드", path) and wanted and r.get("id") not in referred:
                notes.append(f"{r['id']}: asked for in {', '.join(wanted)}")
                for k, d in enumerate(wanted):
                    out["relations"].append({**r, "id": r["id"] if k == 0 else _fresh(out, f"{r['id']}_scope", k), "subject_domain": d})
                continue
        out["relations"].append(r)
    return (out if notes or out["relations"] != list(intent.get("relations", ())) else intent), notes


def domestic_by_default(intent: dict, question: str) -> tuple[dict, list[str]]:
    """ETFs that hold something, with no market named, are domestic ones."""
    holding = any(r.get("relation") in HOLDS for r in intent.get("relations", ()))
    if not holding or not re.search("ETF|상장지수", question, re.I) or re.search(OVERSEAS, question) or not any(d.get("domain") == "해외ETF" for d in intent.get("product_domain", ())):
        return intent, []
    home = lambda d: "국내ETF" if d == "해외ETF" else d
    domains = [{**d, "domain": home(d.get("domain"))} for d in intent["product_domain"]]
    relations = [{**r, "subject_domain": "국내ETF"} if r.get("subject_domain") in ("ETF", "해외ETF") else r for r in intent["relations"]]
    return {**intent, "product_domain": domains, "relations": relations}, ["no market is named: domestic ETFs"]


GUARDS: tuple[Guard, ...] = (plain_fields, relations_among_conditions, themes_in_words, product_relations, domestic_by_default, said_once)


def guarded(intent: dict, question: str = "") -> tuple[dict, list[str]]:
    """The intent after all guards, and what they did."""
    notes: list[str] = []
    for guard in GUARDS:
        intent, said = guard(intent, question)
        notes += said
    return intent, notes
