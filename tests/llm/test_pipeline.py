"""The pipeline against the brute-force stages in a row."""

from collections import Counter

import corpus_pipeline
import pytest

from lattica.llm import mixing, pieces

from tests.llm.test_documents import ODD, SCHEMA, base_rules, brute, same_text, water, WORD, frame


def expected(rows):
    rows = [r for r in rows if not base_rules(r[1])[-1]]  # no line of these tables is above the limits
    out, seen = [], set()
    best = {}
    for i, keep, _, kept, sha in same_text(rows).elements():
        if kept:
            best[sha] = keep
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        norm = "".join(WORD.findall(r[1] or ""))
        if norm not in seen and r[0] in best.values():
            key = [x for x in rows if "".join(WORD.findall(x[1] or "")) == norm]
            longest = max(len(x[1] or "") for x in key)
            if len(r[1] or "") == longest:
                seen.add(norm)
                out.append(r)
    rows, out = out, []
    for (i, _, least), _ in brute(rows).items():
        if i == least:
            out += [r for r in rows if r[0] == i][:1]
    sizes = Counter()
    for _, t, s in out:
        sizes[s] += len(WORD.findall(t))
    return out, water(sizes), sizes


def test_pipeline_rows(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    kept, goal, sizes = expected(docs)
    by_id = {i: (t, s) for i, t, s in kept}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    counts = Counter(r.doc_id for r in got)
    assert counts.keys() <= by_id.keys()
    for i, (t, s) in by_id.items():
        rate = min(goal[s] / sizes[s], 3)
        assert int(rate) <= counts[i] <= int(rate) + 1
    codec = pieces.codec()
    assert all(r.lossless and codec.decode(r.ids) == by_id[r.doc_id][0] for r in got)
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(spark.createDataFrame(kept, "doc_id long, text string, source string")).collect()}
    assert counts == Counter({i: n for i, n in plan.items() if n})


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir):
    long = [(50, " ".join(f"w{i}" for i in range(60)), "s9"), (50, " ".join(f"w{i}" for i in range(60)), "s9"), (None, " ".join(f"v{i}" for i in range(60)), None)]
    for rows in (ODD + long, []):
        docs = frame(spark, rows)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < 4:
                assert docs.columns == SCHEMA.replace(",", "").split()[::2]
            if k == 2 and rows:
                assert Counter(r.doc_id for r in docs.collect()) == {50: 1, None: 1}
        assert docs.count() >= (1 if rows else 0)


def test_lines_above_the_limits_leave_the_texts(spark, sf_dir):
    own = lambda i: " ".join(f"o{i}x{j}" for j in range(40))
    rows = [(i, f"{own(i)}\n\nThe  Menu of this site\nend {i}" + "\nthe menu OF this site " * (i % 2), "h") for i in range(70)]
    rows += [(100, f"{own(100)}\nthe menu of this site", "other"), (5, rows[5][1], "other"), (None, f"{own(101)}\nthe menu of this site", "h")]
    docs = frame(spark, rows)
    out = corpus_pipeline.keep_good(spark, docs, sf_dir)
    assert out.columns == docs.columns
    want = [(i, f"{own(i)}\n\nend {i}", "h") for i in range(70)] + [rows[70], rows[71], (None, own(101), "h")]
    got = [(r.doc_id, r.text, r.source, r.n_chars) for r in out.collect()]
    assert Counter(got) == Counter((i, t, s, len(t) if s == "h" else None) for i, t, s in want)
