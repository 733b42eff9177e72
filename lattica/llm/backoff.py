"""Stupid-backoff scores of documents against the n-gram counts of all other documents.

The relations are: exploded n-grams (one block of documents a row, whole texts, packed), count tables (n-grams by range
of their hash, each block's distinct n-grams with their counts summed), and their join back to the blocks. A block sends
each distinct n-gram once with its count, so the most frequent n-gram of the corpus is one entry a block, never a hot
key; the table answers with one total for each entry, in the same order. Scores are then summed per document.

Hashes are dealt into RANGES ranges, so a block sends at most so many rows however large the corpus is, each with its
share of the block's entries. Where a range's entries are more than a task should hold, blocks are dealt into groups: a
group's entries of a range are first merged into one sorted list, the lists meet by narrower ranges, and their totals go
back through the groups to the blocks. No task holds more than HELD entries at once, on average. Blocks themselves stay
where they were written, in the shared folder: totals are brought to them, and whoever scores a block reads it there.

A document's own occurrences are subtracted from every count, so that it doesn't vouch for itself:
S(w | context) = c(context w) / c(context) if c(context w) > 0, else ALPHA * S(w | shorter context), and for single words
c(w) / N, or 1 / (N + 1) where no other document has the word, with N the words of the other documents. N-grams are told
apart by hashes of 28 bits more than it takes to number them (64 at most).

Defined results: a text without words (null, empty, white) has log_prob 0 and a null mean; a null id scores like any other; rows that
repeat are documents that vouch for each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, fresh_path, own_columns, shuffle_partitions

ORDER = 3
ALPHA = 0.4
#: Words of a block (a longer document is a block of its own).
BLOCK_WORDS = 1_000_000
#: Ranges of hashes, and the entries that a task holds at once, on average.
RANGES = 256
HELD = 4_000_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _pack(a: np.ndarray, level: int = 3) -> bytes:
    """An integer array by planes of bytes, compressed."""
    import zstandard

    width = a.dtype.itemsize
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _pack_sorted(a: np.ndarray) -> bytes:
    """Sorted numbers, or a few sorted runs, by their differences (which may wrap around)."""
    return _pack(np.diff(a, prepend=np.uint64(0)), 1)


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _extend(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the n-gram of a context's hash and a word's."""
    with np.errstate(over="ignore"):
        x = (context ^ (context >> np.uint64(31))) * _A + word
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))



class Block:
    """Words of some documents: `hashes` of the distinct words; `words`, their places in it in order; `lengths`."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray, lengths: np.ndarray):
        self.hashes, self.words, self.lengths = hashes, words, lengths
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def grams(self, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length k: the words that end a k-gram inside their document, and the k-grams' hashes."""
        at, h = np.arange(len(self.words)), self.hashes[self.words]
        out, last = [(at, h)], h
        for k in range(2, order + 1):
            ends = at[self.place >= k - 1]
            full = np.zeros(len(at), np.uint64)
            full[ends] = _extend(last[ends - 1], h[ends])
            last = full
            out.append((ends, full[ends]))
        return out

    def keys(self, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct k-grams of all lengths by hash, and how often each occurs."""
        every = [np.unique(h >> np.uint64(64 - bits), return_counts=True) for _, h in self.grams(order)]
        keys, count = np.concatenate([k for k, _ in every]), np.concatenate([c for _, c in every])
        at = np.argsort(keys, kind="stable")
        return keys[at], count[at]

    def entries(self, order: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: the words that end a k-gram, and each k-gram's place in `keys`."""
        grams = self.grams(order)
        own = [np.unique(h >> np.uint64(64 - bits), return_inverse=True) for _, h in grams]
        at = np.argsort(np.concatenate([k for k, _ in own]), kind="stable")
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        held = 0
        for (ends, _), (k, inverse) in zip(grams, own, strict=True):
            yield ends, place[inverse + held]
            held += len(k)


def explode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(part, block, n, docs, lengths, hashes, words): blocks of documents as packed word sequences, by input partition.

    Words are numbered by how often they occur in their block (in powers of two), so that most numbers are small.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        number = TaskContext.get().partitionId() << 32
        ids, lengths, words, held, own_type = [], [], [], 0, None
        seen = defaultdict()
        seen.default_factory = seen.__len__

        def block() -> pa.RecordBatch:
            nonlocal ids, lengths, words, held, number
            raw, local = np.array([xxh64_intdigest(w) for w in seen], np.uint64), np.concatenate([np.zeros(0, np.int64), *words])
            often = np.frexp(np.bincount(local, minlength=len(raw)))[1]
            order = np.lexsort((raw, -often))
            place = np.empty(len(raw), np.uint32)
            place[order] = np.arange(len(raw), dtype=np.uint32)
            row = (number >> 32, number, held, ids, lengths, _pack_sorted(raw[order]), _pack(place[local]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(own_type), pa.list_(pa.int32()), pa.binary(), pa.binary())
            number, ids, lengths, words, held = number + 1, [], [], [], 0
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["part", "block", "n", "docs", "lengths", "hashes", "words"])

        for batch in batches:
            own_type = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = (t.as_py() or b"").split()
                if held and held + len(found) > block_words:
                    yield block()
                ids.append(i)
                lengths.append(len(found))
                words.append(np.array(list(map(seen.__getitem__, found)), np.int64))
                held += len(found)
        if ids:
            yield block()

    return own.mapInArrow(run, f"part bigint, block bigint, n bigint, docs array<{kind}>, lengths array<int>, hashes binary, words binary")


def _block_of(hashes, words, lengths) -> Block:
    return Block(_unpack_sorted(hashes), _unpack(words, np.uint32).astype(np.int64), np.array(lengths, np.int64))


def _cut(keys: np.ndarray, low: int, high: int, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to): what of the sorted keys lies in each of `parts` equal ranges of low..high-1, where anything does."""
    starts = np.array([low + (high - low) * p // parts for p in range(parts)], np.uint64)
    at = np.append(np.searchsorted(keys, starts), len(keys)).tolist()
    return ((p, a, b) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a)


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"keys": pa.binary(), "counts": pa.binary(), "totals": pa.binary()}
    names = names.split()
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names)


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, list[list]]]:
    """Adjacent rows that agree in their first `by` columns, with the other columns as lists."""
    held, at = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:by] != at:
                if held:
                    yield at, list(map(list, zip(*held, strict=True)))
                held, at = [], row[:by]
            held.append(row[by:])
    if held:
        yield at, list(map(list, zip(*held, strict=True)))


def _summed(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys, their summed counts, each entry's place among them, and how many entries each list has."""
    lists = [_unpack_sorted(k) for k in keys]
    own, place = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([_unpack(c, np.uint64) for c in counts])).astype(np.uint64)
    return own, total, place, [len(x) for x in lists]


def asked(blocks: DataFrame, order: int, bits: int, ranges: int, groups: int) -> DataFrame:
    """(range, team, block, keys, counts): each block's distinct n-grams by range, at most `ranges` rows a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes, words, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, count = _block_of(hashes, words, lengths).keys(order, bits)
                team = ((block * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 20) % groups
                rows = [(r, team, block, _pack_sorted(keys[a:b]), _pack(count[a:b].astype(np.uint64))) for r, a, b in _cut(keys, 0, 1 << bits, ranges)]
                for k in range(0, len(rows), 64):
                    yield _batch(rows[k : k + 64], "range team block keys counts")

    return blocks.select("block", "hashes", "words", "lengths").mapInArrow(run, "range bigint, team bigint, block bigint, keys binary, counts binary")


def _together(rows: DataFrame, parts: int, by: list[str], most: int) -> DataFrame:
    """`rows` in `parts` partitions, those that agree in `by` (numbers, the last below `most`) adjacent; external sort."""
    number = F.col(by[0]) if len(by) == 1 else F.col(by[0]) * most + F.col(by[1])
    others = [c for c in rows.columns if c not in by]
    return rows.select(*by, *others).repartitionById(parts, F.pmod(number, F.lit(parts)).cast("int")).sortWithinPartitions(*by)


def counts(blocks: DataFrame, order: int, words: int, ranges: int = RANGES, held: int = HELD) -> DataFrame:
    """(block, range, totals): the totals over all blocks of a block's distinct n-grams in a range of hashes."""
    bits = hash_bits(order, words)
    groups = max(1, -(-order * words // (ranges * held)))
    parts = min(ranges * groups, max(shuffle_partitions(blocks.sparkSession), order * words // (8 * held)))
    rows = asked(blocks, order, bits, ranges, groups)

    def answer(batches: Iterator[pa.RecordBatch], by: int, names: str) -> Iterator[pa.RecordBatch]:
        for at, (own, keys, count) in _runs(batches, by):
            _, total, place, sizes = _summed(keys, count)
            for x, totals in zip(own, np.split(total[place], np.cumsum(sizes)[:-1]), strict=True):
                yield _batch([(*at, x, _pack(totals))], names)

    if groups == 1:
        return _together(rows.drop("team"), parts, ["range"], 1).mapInArrow(lambda b: answer(b, 1, "range block totals"), "range bigint, block bigint, totals binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One list a range and team, by narrower ranges."""
        for (r, team), (_, keys, count) in _runs(batches, 2):
            own, total, _, _ = _summed(keys, count)
            low, high = (r << bits) // ranges, ((r + 1) << bits) // ranges
            for sub, a, b in _cut(own, low, high, groups):
                yield _batch([(r, sub, team, _pack_sorted(own[a:b]), _pack(total[a:b]))], "range sub team keys counts")

    def spread(rows: pa.Table, totals: pa.Table) -> pa.Table:
        """A team's totals to its blocks: its list is what merging its rows gives."""
        r, block, keys, count = (rows.column(c).to_pylist() for c in ("range", "block", "keys", "counts"))
        found = sorted(zip(totals.column("sub").to_pylist(), totals.column("totals").to_pylist(), strict=True))
        total = np.concatenate([_unpack(t, np.uint64) for _, t in found])
        _, _, place, sizes = _summed(keys, count)
        own = [_pack(t) for t in np.split(total[place], np.cumsum(sizes)[:-1])]
        return pa.table({"range": pa.array(r, pa.int64()), "block": pa.array(block, pa.int64()), "totals": pa.array(own, pa.binary())})

    rows = cut(rows)
    lists = _together(rows, parts, ["range", "team"], groups).mapInArrow(merge, "range bigint, sub bigint, team bigint, keys binary, counts binary")
    totals = _together(lists, parts, ["range", "sub"], groups).mapInArrow(lambda b: answer(b, 2, "range sub team totals"), "range bigint, sub bigint, team bigint, totals binary")
    return rows.groupBy("range", "team").cogroup(totals.groupBy("range", "team")).applyInArrow(spread, "range bigint, block bigint, totals binary")


def hash_bits(order: int, words: int) -> int:
    """Width of hashes: 28 bits more than it takes to number all n-grams, 64 at most."""
    return min(64, 28 + max(order * words, 1).bit_length())


def scores_of(block: Block, totals: np.ndarray, words_in_all: int, order: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Per document: the summed log scores and how many words were scored on a shorter context than they have."""
    n = len(block.words)
    rest = (words_in_all - block.lengths[block.doc]).astype(np.float64)
    log_score, used, shorter = np.zeros(n), np.ones(n, np.int64), None
    for k, (ends, entry) in enumerate(block.entries(order, hash_bits(order, words_in_all)), 1):
        _, same, own = np.unique(block.doc[ends] * np.int64(len(totals) + 1) + entry, return_inverse=True, return_counts=True)
        others = np.zeros(n)  # occurrences in other documents of the k-gram that ends at each word
        others[ends] = totals[entry].astype(np.float64) - own[same]
        if k == 1:
            log_score = np.log(np.where(others > 0, others / np.maximum(rest, 1), 1 / (rest + 1)))
        else:
            ok = ends[others[ends] > 0]
            log_score[ok] = np.log(others[ok] / shorter[ok - 1])
            used[ok] = k
        shorter = others
    top = np.minimum(block.place + 1, order)
    log_score += np.log(alpha) * (top - used)
    docs = len(block.lengths)
    return np.bincount(block.doc, weights=log_score, minlength=docs).astype(float), np.bincount(block.doc, weights=used < top, minlength=docs).astype(np.int64)


def _blocks_at(path: str, part: int) -> Iterator[dict]:
    """The blocks of one input partition, in order, from where `score` wrote them."""
    fs, root = pafs.FileSystem.from_uri(path)
    for f in sorted(fs.get_file_info(pafs.FileSelector(f"{root}/part={part}")), key=lambda f: f.path):
        if f.base_name.endswith(".parquet"):
            with fs.open_input_file(f.path) as data:
                for batch in pq.ParquetFile(data).iter_batches(batch_size=1, columns=["block", "docs", "lengths", "hashes", "words"]):
                    yield {c: batch.column(i)[0] for i, c in enumerate(batch.schema.names)}


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, block_words: int = BLOCK_WORDS, ranges: int = RANGES, held: int = HELD) -> DataFrame:
    """doc_id, n_words, log_prob (natural, summed), mean_log_prob, n_backoff for every document."""
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    path, schema = fresh_path(spark, "blocks"), f"doc_id {kind}, n_words bigint, log_prob double, mean_log_prob double, n_backoff bigint"
    made = explode(own_columns(docs, doc_id=doc_id, text=text), block_words=block_words)
    made.write.partitionBy("part").parquet(path)
    blocks = spark.read.schema(made.schema).parquet(path)
    words_in_all, last = blocks.agg(F.sum("n"), F.max("part")).first()
    if last is None:
        return spark.createDataFrame([], schema)
    found = counts(blocks, order, words_in_all, ranges, held).select("block", "range", "totals")
    every = found.union(blocks.select("block", F.lit(-1), F.lit(b"")))  # so that blocks without words are scored too
    answers = every.select(F.shiftright("block", 32).alias("part"), "block", "range", "totals")
    parts = min(last + 1, shuffle_partitions(spark))
    brought = answers.repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")).sortWithinPartitions("part", "block", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks_of = None, iter(())
        for (part, block), (_, totals) in _runs(batches, 2):
            if part != at:
                at, blocks_of = part, _blocks_at(path, part)
            own = next(b for b in blocks_of if b["block"].as_py() == block)
            b = _block_of(own["hashes"].as_py(), own["words"].as_py(), own["lengths"].as_py())
            logs, backed = scores_of(b, np.concatenate([np.zeros(0, np.uint64), *(_unpack(x, np.uint64) for x in totals[1:])]), words_in_all, order, alpha)
            some = b.lengths > 0
            mean = pa.array(np.where(some, logs / np.maximum(b.lengths, 1), 0.0), mask=~some)
            yield pa.RecordBatch.from_arrays([own["docs"].values, pa.array(b.lengths), pa.array(logs), mean, pa.array(backed)], ["doc_id", "n_words", "log_prob", "mean_log_prob", "n_backoff"])

    return brought.mapInArrow(run, schema)
