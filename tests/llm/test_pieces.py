"""SentencePiece pieces: against the library without dropout, exact round trips with it."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import pieces

SPECIAL = ["", " ", "  a  b ", "\n\n x\ty", "naïve façade — 執筆 🙂🙂", "▁literal▁ mark", "\0 nul\x0b", "don't stop!!! (really)", "a" * 500, "word" * 60 + " end", "été́ ﬁ", "\r\n"]


@pytest.fixture(scope="module")
def codec():
    return pieces.codec()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def test_without_dropout_it_is_the_library(codec, library, spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    for t in texts + [x for x in SPECIAL if "▁" not in x]:
        assert codec.encode(t) == library.encode(t), t[:80]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80), st.integers(0, 2**32), st.sampled_from([0.0, 0.1, 0.5, 0.95]))
def test_round_trip(codec, text, key, rate):
    text = text.encode("utf-8", "ignore").decode()
    assert codec.decode(codec.encode(text, key, rate)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdethisonr", min_size=1, max_size=20), st.integers(0, 2**63), st.sampled_from([0.0, 0.1, 0.5]))
def test_arrays_and_heap_agree(codec, word, key, rate):
    import numpy as np

    s = codec.symbols(pieces.SPACE + word)
    assert codec.agenda(s, key, rate) == np.frombuffer(codec.together(np.array([s]), np.array([key], np.uint64), rate)[0], np.int32).tolist()


def test_literal_marks_and_library_decoding(codec, library):
    for t in SPECIAL:
        for rate in (0.0, 0.3):
            ids = codec.encode(t, 5, rate)
            assert codec.decode(ids) == t
            assert not t or library.decode(ids) == t


def test_dropout_varies_by_key_and_repeats(codec):
    text = "the international organisation " * 3
    cuts = {tuple(codec.encode(text, key, 0.2)) for key in range(20)}
    assert len(cuts) > 10
    assert codec.encode(text, 3, 0.2) == codec.encode(text, 3, 0.2)
    assert len(codec.encode(text, 3, 1.0)) == len(text) + 1 and len(codec.encode(text)) < len(codec.encode(text, 3, 0.5))


def test_encode_and_decode_frames(spark):
    rows = [(1, "A small text."), (1, "A small text."), (2, None), (None, ""), (3, "é" * 3000), *[(10 + i, x) for i, x in enumerate(SPECIAL)]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    got = pieces.encode(df)
    assert {(r.doc_id, r.ids is None, r.lossless, r.n_tokens == len(r.ids or [])) for r in got.collect()} == {(i, t is None, None if t is None else True, True) for i, t in rows}
    back = pieces.decode(got).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=repr) == sorted(rows, key=repr)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, pieces.encode(df.repartition(3)).collect()))
    assert pieces.encode(df.limit(0)).count() == 0


def test_each_occurrence_is_cut_by_its_own_draws(spark, codec, sf_dir):
    """The trees of chunks against a plain reading of the rule; one word over many documents."""
    from xxhash import xxh64_intdigest

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(25).collect()] + [(None, "null id"), (7, "a" * 60 + " " * 40 + "b"), (8, "pneumonoultramicroscopicsilicovolcanoconiosis")]
    rows += [(1000 + i, "internationalisation and internationalisation") for i in range(2000)]
    for rate in (0.1, 0.7):
        own = pieces.Encoder(codec, rate=rate, kept=500)
        got = []
        for k in range(0, len(rows), 300):
            part = rows[k : k + 300]
            got += [x.tolist() for x in own.encode([i for i, _ in part], [t for _, t in part])]
        for (i, t), ids in zip(rows[:300], got):
            assert ids == codec.encode(t, xxh64_intdigest(f"{pieces.SEED}:{i}"), rate)
        assert all(codec.decode(ids) == t for (_, t), ids in zip(rows, got))
        if rate == 0.1:
            words = [tuple(ids[: ids.index(next(i for i in ids if codec.pieces[i].startswith("▁and")))]) for ids in got[-2000:] if any(codec.pieces[i] == "▁and" for i in ids)]
            assert len(set(words)) > 100
