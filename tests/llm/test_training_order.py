"""Training order: the permutation by enumeration, the shards by an exact round trip."""

import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import training_order as t


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation(n, seed):
    slots = t.slot_of(np.arange(n), n, seed)
    assert sorted(slots.tolist()) == list(range(n))
    assert t.index_of(slots, n, seed).tolist() == list(range(n))


def test_permutation_depends_on_the_key_and_mixes():
    a, b = t.slot_of(np.arange(5000), 5000, 1), t.slot_of(np.arange(5000), 5000, 2)
    assert (a == b).mean() < 0.01 and abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.1


@pytest.mark.parametrize("length, per_shard, tasks", [(7, 5, None), (64, 1000, None), (64, 20, 3)])
def test_round_trip(spark, sf_dir, length, per_shard, tasks):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(900, None), (901, ""), (None, "null id"), (902, "same"), (902, "same")], "doc_id long, text string")
    all_docs = docs.union(odd).repartition(3)
    path = "file://" + tempfile.mkdtemp()
    index = t.materialise(all_docs, path, length=length, per_shard=per_shard, tasks=tasks).orderBy("slot").collect()
    sequences = list(t.read_slots(path))
    assert [r.slot for r in index] == list(range(len(sequences)))
    assert all(zlib.crc32(s) == r.crc32 and (s != t.PAD).sum() == r.n_tokens for s, r in zip(sequences, index))
    assert all(r.shard == r.slot // per_shard and r.byte_offset == r.slot % per_shard * 2 * length for r in index)
    ordered = np.concatenate([sequences[s] for s in t.slot_of(np.arange(len(sequences)), len(sequences))])
    ids, texts = ordered[ordered != t.PAD], []
    for piece in np.split(ids, np.flatnonzero(ids == t.END) + 1)[:-1]:
        texts.append(t.tokenizer().decode(piece[:-1].tolist()))
    assert Counter(texts) == Counter(r.text or "" for r in all_docs.collect())
    assert [s.tolist() for s in t.read_slots(path, 3, 9)] == [s.tolist() for s in sequences[3:9]]
    by_id = {r.doc_id: r.text or "" for r in all_docs.collect()}
    for k, s in enumerate(sequences):
        first = s[s != t.PAD]
        stop = np.flatnonzero(first == t.END)
        said = t.tokenizer().decode_bytes(first[: stop[0] if len(stop) else len(first)].tolist())
        assert said in by_id[index[k].doc_id].encode()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id string, text string, slot int")
    path = "file://" + tempfile.mkdtemp()
    assert t.materialise(none, path).count() == 0 and list(t.read_slots(path)) == []


@pytest.mark.parametrize("gap", [" ", "\n", "\t \u3000", "\xa0"])
def test_long_white_space_is_one_piece_as_in_the_pattern(monkeypatch, gap):
    import re

    monkeypatch.setattr(t, "_RUN", re.compile(f"[{t.WHITE}]{{3,}}"))
    for text in ("a{}b", "{}b", "a{}", "{}", "a's {}!{}\n.{}7{} x", "a\x1c{}\x1db"):
        text = text.replace("{}", gap * 4)
        assert t.encode(text).tolist() == t.tokenizer().encode_to_numpy(text).tolist()


def test_very_long_texts(spark):
    texts = [" " * 5_000_000, "a" + " " * 1_500_000 + "b" + "\n" * 1_200_000, "x" * 1_000_000, "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = "file://" + tempfile.mkdtemp()
    t.materialise(docs.coalesce(1), path)
    ids = np.concatenate(list(t.read_slots(path)))
    n = len(ids) // t.LENGTH
    ordered = np.concatenate([ids.reshape(n, -1)[s] for s in t.slot_of(np.arange(n), n)])
    ordered = ordered[ordered != t.PAD]
    pieces = np.split(ordered, np.flatnonzero(ordered == t.END) + 1)[:-1]
    assert [t.tokenizer().decode(p[:-1].tolist()) for p in pieces] == texts


def test_ids_that_do_not_fit_are_an_error(tmp_path):
    import base64

    path = str(tmp_path / "big")
    with open(path, "wb") as f:
        f.write(b"".join(base64.b64encode(i.to_bytes(1, "big") if i < 256 else b"x" + i.to_bytes(3, "big")) + b" %d\n" % i for i in range(65_600)))
    with pytest.raises(ValueError, match="16 bits"):
        t.end_mark(path)
    t.tokenizer.cache_clear()
    t.end_mark.cache_clear()


def test_a_run_that_died_does_not_look_whole(spark, tmp_path):
    with pytest.raises(Exception):
        t.materialise(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), f"file://{tmp_path}", vocabulary="/nowhere")
    assert not (tmp_path / "meta.json").exists()
