"""Mixing, exact and near deduplication and quality rules against brute force on small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import exact_dedup, mixing, quality_rules, simhash
from lattica.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, fp string, line string, _id string, _k_id string, _nth int, _mix_n int, _GONE int"


def frame(spark, rows):
    """Rows (doc_id, text, source), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, None, "x", 7, "y", "z", "p", "q", 1, 2, 3) for i, t, s in rows], SCHEMA)


ODD = [(1, "a b  c", "s1"), (1, "a b  c", "s1"), (2, "abc", "s1"), (3, None, "s2"), (4, "", None), (None, "a\tb c", "s2"), (5, "é a b \x0b", None), (6, " \n ", "s3"), (7, "word " * 3000, "s1"), (8, "One two\nOne two\nthree", "s2")]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r.doc_id, r.text, r.source) for r in documents.collect()]


# --- mixing


def water(sizes, weights=mixing.WEIGHTS, cap=mixing.CAP):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(cap * sizes[s] for s in capped)) / max(sum(w[s] for s in free), 1)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else level * w[s] for s in order}
        capped |= over


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=12))
def test_targets_are_a_capped_share_by_weight(spark, sizes):
    rows = [(f"s{i:02}", n) for i, n in enumerate(sizes)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = water(dict(rows))
    assert got == pytest.approx(want)


def test_mix_plan_by_hand(spark):
    rows = mixing.mix_plan(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    sizes = Counter()
    for _, t, s in ODD:
        sizes[s] += len(WORD.findall(t or ""))
    goal = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        rate = min(r.target / r.source_size, 3) if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + (rate % 1 > 0)) and r.taken == r.copies * r.size
    emitted = mixing.mix(frame(spark, ODD))
    assert emitted.columns == SCHEMA.replace(",", "").split()[::2]
    assert Counter(r.doc_id for r in emitted.collect()) == Counter({k: v for k, v in Counter({r.doc_id: 0 for r in rows}).items()} | {i: n for i, n in _by_id(rows).items() if n})


def _by_id(rows):
    n = Counter()
    for r in rows:
        n[r.doc_id] += r.copies
    return n


def test_mix_comes_near_its_targets(documents):
    rows = mixing.mix_plan(documents).collect()
    again = {r.doc_id: r.copies for r in mixing.mix_plan(documents).collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    assert sum(r.taken for r in rows) == pytest.approx(sum(r.size for r in rows), rel=0.2)
    assert all(r.taken <= 3 * r.size for r in rows)


# --- exact deduplication


def same_text(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = Counter()
    for norm, g in groups.items():
        g.sort()
        for k, x in enumerate(g):
            out[(x[3], g[0][3], len(g), k == 0, hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("ranges", [1, 5])
def test_exact_groups_by_hand(spark, texts, ranges):
    hot = [(100 + i, "hot text" + " " * (i % 3), "s1") for i in range(300)]
    odd = [(500 + i, 'q"\\\x01🙂\u2028' + "\t" * (i % 2), "s1") for i in range(200)] + hot[:40]
    for rows in (ODD, hot + ODD, odd, texts):
        got = Counter(tuple(r) for r in exact_dedup.exact_groups(frame(spark, rows), ranges=ranges).drop("text_key").collect())
        assert got == same_text(rows)


def test_what_stays(spark, texts):
    columns = SCHEMA.replace(",", "").split()[::2]
    for rows in (ODD, [(i + 1000, t, s) for i, t, s in texts] + ODD):
        stay = exact_dedup.deduplicated(frame(spark, rows), ranges=4)
        assert stay.columns == columns
        assert Counter(r.doc_id for r in stay.collect()) == Counter(i for (i, _, _, kept, _), n in same_text(rows).items() for _ in range(n) if kept)
        stay = simhash.survivors(frame(spark, rows))
        assert stay.columns == columns
        groups = {least for _, _, least in brute(rows)}
        assert Counter(r.doc_id for r in stay.collect()) == Counter(groups)


# --- quality rules


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_base_rules_by_hand(spark, texts):
    extra = [(20, "a b c d e f g h " * 5, "s"), (21, " ".join(map(str, range(40))) + " x " + " ".join(map(str, range(9))), "s"), (22, "# $\n \n# $\n#", "s")]
    rows = ODD + extra + texts
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(frame(spark, rows)).collect())
    assert got == Counter((i, *base_rules(t)) for i, t, _ in rows)


def verdicts(rows):
    """(doc_id, removed_chars, kept) of each row by the rule's plain reading: a line's distinct texts on its host."""
    lines = lambda t: [(" ".join(WORD.findall(x)).lower(), sum(map(len, WORD.findall(x)))) for x in (t or "").split("\n") if WORD.search(x)]
    texts, seen = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        texts[s].add(t or "")
        for x, _ in lines(t):
            seen[s, x].add(t or "")
    out = Counter()
    for i, t, s in rows:
        n, chars, *_, failed = base_rules(t)
        gone = 0 if failed else sum(c for x, c in lines(t) if len(seen[s, x]) > quality_rules.LINE_DOCS and len(seen[s, x]) > quality_rules.LINE_SHARE * len(texts[s]))
        out[i, gone, not failed and chars - gone >= quality_rules.MIN_LEFT * chars] += 1
    return out


def test_line_frequency(spark, texts):
    def own(i, n=30):
        return " ".join(f"w{i}x{j}" for j in range(n))

    common = " ".join(f"menu{j}" for j in range(34))
    mostly = [(i, f"{common}\n{own(i, 3)}", "h") for i in range(30)]  # nothing else but three words
    partly = [(100 + i, f"{common}\n{own(i + 500, 120)}", "h") for i in range(100)]
    copied = [(200 + i, "\n".join(own(j + 1000, 20) for j in range(4)), "h") for i in range(200)]  # copies of one text
    edited = [(500 + i, "\n".join(own(j + 2000, 25) for j in range(5)) + f"\nedit {i}", "h") for i in range(200)]  # documents of their own
    spread = [(800 + i, f"{common}\n{own(i + 3000)}", f"h{i % 3}" if i % 4 else None) for i in range(240)]
    rows = mostly + partly + copied + edited + spread + [(i if i is None else i + 10_000, t, s) for i, t, s in ODD + texts]
    out = quality_rules.quality_rules(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.removed_chars, r.kept) for r in out) == verdicts(rows)
    kept = {r.doc_id: r.kept for r in out}
    assert not any(kept[i] for i, _, _ in mostly + edited)
    assert all(kept[i] for i, _, _ in partly + copied)


def test_depleted_documents_of_many_hosts(spark):
    words = lambda c, n: " ".join(f"{c}{j}" for j in range(n))
    rows = [(1000 * h + i, f"{words(f'menu{h}x', 50)}\n{words(f'own{h}x{i}x', 8)}", f"host{h}") for h in range(24) for i in range(150)]
    out = quality_rules.quality_rules(frame(spark, rows)).collect()
    assert len(out) == 3600 and not any(r.kept for r in out)


@pytest.mark.parametrize("own", [3, 8, 15])
def test_line_of_depleted_documents_only(spark, own):
    """No other document of the host has the line, so nothing but the depleted ones can put it above the limits."""
    words = lambda i, n: " ".join(f"o{i}x{j}" for j in range(n))
    menu = " ".join(f"commonmenu{j}" for j in range(60))
    rows = [(i, f"{menu}\n{words(i, own)}", "h") for i in range(120)]
    rows += [(1000 + i, words(1000 + i, 80), "h") for i in range(60)]
    two = [" ".join(f"{c}{j}" for j in range(35)) for c in ("commonhead", "commonfoot")]
    rows += [(2000 + i, f"{two[0]}\n{words(2000 + i, 12)}\n{two[1]}", "two") for i in range(120)]
    rows += [(3000 + i, menu, "copies") for i in range(120)]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert all(kept[i] == (1000 <= i < 2000 or i >= 3000) for i in kept)


# --- near duplicates


def brute(rows):
    fps = []
    for i, t, _ in rows:
        words = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())]
        shingles = [" ".join(words[j : j + 3]) for j in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 2:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        r = find(k)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return Counter((i, f"{fp:016x}", least[find(k)]) for k, (i, fp) in enumerate(fps))


@pytest.mark.parametrize("bucket", [1, 64])
def test_near_duplicates_by_hand(spark, texts, bucket):
    words = texts[0][1].split()
    near = [(1000 + i, " ".join([*words, *(f"z{i}" for _ in range(i % 4))]), "s") for i in range(30)]
    for rows in (ODD, texts + near + ODD):
        got = Counter(tuple(r) for r in simhash.near_duplicates(frame(spark, rows), bucket=bucket).collect())
        assert got == brute(rows)


def test_links_are_complete_in_dense_neighbourhoods(spark):
    import random

    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(60)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {frozenset((a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    root = {}
    for bucket in (1, 8, 1000):
        found = simhash.links(df, bucket=bucket)
        pairs = {frozenset(r) for r in found.collect()}
        assert pairs <= want
        root[bucket] = {r.node: r.root for r in components(found).collect()}
    assert root[1] == root[8] == root[1000]
    assert all(root[1][a] == root[1][b] for a, b in map(tuple, want))


def test_thresholds_by_dynamic_programming():
    assert simhash.allocate([[5, 50, 500], [5, 50, 500], [5, 50, 500]]) == [0, 0, 0]
    assert simhash.allocate([[1, 2, 500], [1, 50, 500], [900, 9000, 9e4]]) == [1, 0, -1]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {j: 100 for j in range(100, 160)}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert mixing.mix_plan(none).count() == mixing.mix(none).count() == 0
    assert exact_dedup.exact_groups(none).count() == quality_rules.quality_rules(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
