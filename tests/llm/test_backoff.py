"""Stupid backoff against counts in dictionaries."""

import math
from collections import Counter

import pytest

from lattica.llm import backoff


def brute(rows, order, alpha=backoff.ALPHA):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    grams = [[Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) for k in range(1, order + 1)] for _, w in docs]
    total = [sum((g[k] for g in grams), Counter()) for k in range(order)]
    n = sum(total[0].values())
    out = []
    for (i, w), own in zip(docs, grams):
        log, backed = 0.0, 0
        for j in range(len(w)):
            top = min(j + 1, order)
            for k in range(top, 0, -1):
                gram = tuple(w[j - k + 1 : j + 1])
                c = total[k - 1][gram] - own[k - 1][gram]
                rest = n - len(w)
                if k == 1:
                    log += math.log(c / max(rest, 1) if c else 1 / (rest + 1)) + (top - 1) * math.log(alpha)
                    backed += top > 1
                elif c:
                    log += math.log(c / (total[k - 2][gram[:-1]] - own[k - 2][gram[:-1]])) + (top - k) * math.log(alpha)
                    backed += k < top
                    break
        out.append((i, len(w), log, backed))
    return out


@pytest.mark.parametrize("order, block_words, ranges, held", [(1, 1000, 256, 10**6), (2, 10**6, 256, 10**6), (3, 700, 256, 10**6), (3, 700, 3, 2500), (2, 3000, 2, 1200)])
def test_scores_by_hand(spark, sf_dir, order, block_words, ranges, held):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()]
    rows += [(1000, None), (1001, ""), (None, "the the the of"), (1002, " \n"), (1003, "unseen-word-here"), (1004, "of the"), (1004, "of the")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, words string").repartition(5)
    got = sorted(backoff.score(df, order=order, block_words=block_words, ranges=ranges, held=held).collect(), key=lambda r: (str(r.doc_id), r.log_prob))
    want = sorted(brute(rows, order), key=lambda r: (str(r[0]), r[2]))
    assert [(r.doc_id, r.n_words, r.n_backoff) for r in got] == [(i, n, b) for i, n, _, b in want]
    assert [r.log_prob for r in got] == pytest.approx([x for _, _, x, _ in want])
    assert all((r.mean_log_prob is None) == (r.n_words == 0) for r in got)


def test_likely_texts_score_higher(spark):
    rows = [(i, "a cat sat on the mat") for i in range(20)] + [(100, "mat the on sat cat a"), (101, "a cat sat on the mat")]
    got = {r.doc_id: r.mean_log_prob for r in backoff.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[101] > got[100]


def test_query_scores_trigrams(spark, tmp_path):
    """Every bigram of the last text is seen, its trigrams are not: only an order over 2 backs off there."""
    from lattica.llm.queries import QUERIES

    rows = [(1, "a b c"), (2, "d b e"), (3, "a b e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_stupid_backoff"](spark, str(tmp_path)).collect()}
    want = {i: (log, backed) for i, _, log, backed in brute(rows, 3)}
    assert got[3].n_backoff == 1
    assert {i: r.n_backoff for i, r in got.items()} == {i: b for i, (_, b) in want.items()}
    assert {i: r.log_prob for i, r in got.items()} == pytest.approx({i: x for i, (x, _) in want.items()})


def test_empty(spark):
    assert backoff.score(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    assert backoff.score(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].log_prob == 0


@pytest.mark.parametrize("ranges, held", [(16, 10**6), (4, 500)])
def test_rows_exchanged_follow_the_input(spark, sf_dir, ranges, held):
    """Rows that blocks send to the table, at an input and at four times that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sent = []
    for times in (1, 4):
        four = docs.crossJoin(spark.range(times)).drop("id").coalesce(1)
        blocks = backoff.explode(four, block_words=2000)
        n, words = blocks.count(), blocks.groupBy().sum("n").first()[0]
        groups = max(1, -(-3 * words // (ranges * held)))
        rows = backoff.asked(blocks, 3, backoff.hash_bits(3, words), ranges, groups)
        sent.append(rows.count())
        assert sent[-1] <= n * ranges and rows.select("range", "team").distinct().count() <= ranges * groups
    assert sent[1] <= 1.05 * 4 * sent[0]
