"""Token ids in training order, as fixed-stride binary shards.

Texts are tokenised and packed, each followed by an end mark, into sequences of `length` ids. A keyed Feistel network
over the smallest even number of bits that holds all sequences, walked until it lands inside, permutes 0..n-1, so each
sequence has a global slot that can be computed, and inverted, without a table. Slot ranges are partitions: each is one
shard, written in slot order, and slot s lies at byte (s mod per_shard) * stride of shard s div per_shard. A reader that
knows how many sequences it has used resumes by one seek.

Blocks of sequences are kept in the shared folder once, as tokenised; numbering them needs one row a partition. Sequences move
in one shuffle, grouped by map task and shard and compressed. A task writes a run of shards, one in memory at a time, so
that tasks stay as many as the session's shuffle partitions call for, however many shards there are. Shards are written
under a temporary name and moved, so a task that runs twice writes the same file.

Defined results: a null or empty text is an end mark alone; a null id stays null in the index; repeated rows are
sequences of their own; the last sequence of an input partition is filled up with PAD; an empty table has no shards.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut, fresh_path, own_columns, shuffle_partitions

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Ids are 16 bits wide; the end mark is the first id after the vocabulary.
END, PAD = 50256, 65535
#: White space of the splitting pattern; runs of LONG characters or more are cut out before it, whose matcher they overrun.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = 50_000
LENGTH = 1024
PER_SHARD = 8192
SEED = 23
ROUNDS = 6
#: Sequences in a block, bytes that a map task groups before it hands them on, and writing tasks from which on a task
#: writes more than one shard (or the session's shuffle partitions, if they are more).
BLOCK = 256
HELD = 32 << 20
TASKS = 2048

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _round(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * _A
        x = (x ^ (x >> np.uint64(29))) * _B
        x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(f"{seed}/{r}") for r in range(ROUNDS)]


def _walk(x: np.ndarray, n: int, step) -> np.ndarray:
    """`step`, again for what lands outside 0..n-1."""
    out = step(np.asarray(x, np.uint64))
    outside = np.flatnonzero(out >= np.uint64(n))
    while len(outside):
        out[outside] = step(out[outside])
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def slot_of(index: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The slots of sequences `index` among n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low, keys = (np.uint64(1) << half) - np.uint64(1), _keys(seed)

    def step(x):
        left, right = x >> half, x & low
        for k in keys:
            left, right = right, left ^ (_round(right, k) & low)
        return left << half | right

    return _walk(index, n, step)


def index_of(slot: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The inverse of slot_of."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low, keys = (np.uint64(1) << half) - np.uint64(1), _keys(seed)

    def step(x):
        left, right = x >> half, x & low
        for k in reversed(keys):
            left, right = right ^ (_round(left, k) & low), left
        return left << half | right

    return _walk(slot, n, step)


@lru_cache(maxsize=1)
def tokenizer(path: str | None = None):
    """The byte-level BPE of the ranks at `path` (by default a public vocabulary, found through its package)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def end_mark(path: str | None = None) -> int:
    """The first id after the vocabulary; an error if ids don't fit in 16 bits."""
    end = tokenizer(path).max_token_value + 1
    if end >= PAD:
        raise ValueError(f"ids up to {end} don't fit beside the filler {PAD} in 16 bits")
    return end


_RUN = re.compile(f"[{WHITE}]{{{LONG},}}")


def encode(text: str, path: str | None = None) -> np.ndarray:
    """The ids of a text of any length, white space of any length in it included.

    The pattern takes a run of white space before other text less its last character as one piece; so does this.
    """
    own, out, at = tokenizer(path), [], 0
    for run in _RUN.finditer(text):
        last = run.end() if run.end() == len(text) else run.end() - 1
        out += [own.encode_to_numpy(text[at : run.start()], disallowed_special=()), np.array(own._encode_single_piece(text[run.start() : last]), np.uint32)]
        at = last
    out.append(own.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(out).astype(np.uint16)


def _pack(data: bytes, level: int = 6) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def _unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """(part, start, n, data, docs): n sequences from the start-th of an input partition; data holds their ids, 16 bits each,
    docs the id of the document that each one begins in."""
    own = own_columns(docs, doc_id=doc_id, text=text)
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, part = end_mark(vocabulary), TaskContext.get().partitionId()
        rest, starts, size, at = [], [], 0, 0  # ids not yet handed on, where their documents begin

        def block(last: bool):
            nonlocal rest, starts, size, at
            ids = np.concatenate(rest) if rest else np.zeros(0, np.uint16)
            n = -(-len(ids) // length) if last else len(ids) // length
            if n * length > len(ids):
                ids = np.concatenate([ids, np.full(n * length - len(ids), PAD, np.uint16)])
            begins = np.array([s for s, _ in starts])
            first = np.searchsorted(begins, np.arange(n + 1) * length, side="right") - 1
            found = [starts[i][1] for i in first[:n]]
            cutoff = n * length
            keep = [(s - cutoff, i) for s, i in starts[max(first[n], 0) :]] if not last else []
            for k in range(0, n, BLOCK):
                m = min(BLOCK, n - k)
                yield part, at + k, m, _pack(ids[k * length : (k + m) * length].tobytes()), found[k : k + m]
            at, rest, starts, size = at + n, [ids[cutoff:]], keep, len(ids) - cutoff

        def rows(made):
            cols = list(zip(*made, strict=True))
            types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(own_type))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["part", "start", "n", "data", "docs"])

        own_type = None
        for batch in batches:
            own_type = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts.append((size, i))
                if t:
                    rest.append(encode(t, vocabulary))
                    size += len(rest[-1])
                rest.append(np.array([end], np.uint16))
                size += 1
                if size >= 4 * BLOCK * length and (made := list(block(False))):
                    yield rows(made)
        if size and (made := list(block(True))):
            yield rows(made)

    return own.mapInArrow(run, f"part int, start bigint, n int, data binary, docs array<{kind}>")


def materialise(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, seed: int = SEED, vocabulary: str | None = None, tasks: int | None = None) -> DataFrame:
    """Writes the shards and their index under `path` and returns the index: slot, shard, byte_offset, doc_id, n_tokens, crc32."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    made = cut(blocks(docs, doc_id, text, length, vocabulary))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row an input partition
    offsets = cut(made.groupBy("part").agg(F.sum("n").alias("m")).select("part", "m", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base")))
    total = offsets.agg(F.sum("m")).first()[0] or 0
    shards, stride = -(-total // per_shard), 2 * length
    meta = json.dumps({"sequences": total, "length": length, "per_shard": per_shard, "seed": seed, "dtype": "uint16", "pad": PAD, "end": end_mark(vocabulary)}).encode()
    index = f"slot bigint, shard int, byte_offset bigint, doc_id {kind}, n_tokens int, crc32 bigint"
    if not total:
        _write(f"{path}/meta.json", meta)
        return spark.createDataFrame([], index)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sequences of a task by shard."""
        by: dict[int, list] = {}
        held, own_type = 0, None

        def hand_on():
            out = []
            for shard, items in sorted(by.items()):
                slots = np.concatenate([s for s, _, _ in items])
                out.append((shard, slots.tolist(), [d for _, _, ds in items for d in ds], _pack(np.concatenate([x for _, x, _ in items]).tobytes())))
            by.clear()
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.list_(pa.int64()), pa.list_(own_type), pa.binary()), strict=True)], ["shard", "slots", "docs", "data"])

        for batch in batches:
            own_type = batch.column(3).type.value_type
            for start, n, data, ds in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(_unpack(data), np.uint16).reshape(n, length)
                slots = slot_of(start + np.arange(n), total, seed)
                order = np.argsort(slots, kind="stable")
                edges = np.flatnonzero(np.diff(slots[order] // per_shard)) + 1
                for at in np.split(order, edges):
                    by.setdefault(int(slots[at[0]] // per_shard), []).append((slots[at], ids[at], [ds[i] for i in at]))
                held += len(ids) * stride
                if held >= HELD:
                    yield hand_on()
                    held = 0
        if by:
            yield hand_on()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards of a partition one after another; rows come by shard."""
        shard, own_type, ids, owners = None, None, None, None

        def written() -> pa.RecordBatch:
            _write(f"{path}/shard-{shard:08d}.bin", ids)
            slots = shard * per_shard + np.arange(len(ids))
            sums = [zlib.crc32(row) for row in ids]
            return pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array(np.full(len(ids), shard, np.int32)), pa.array((slots - shard * per_shard) * stride), pa.array(owners, own_type), pa.array((ids != PAD).sum(1).astype(np.int32)), pa.array(sums, pa.int64())],
                ["slot", "shard", "byte_offset", "doc_id", "n_tokens", "crc32"],
            )

        for batch in batches:
            own_type = batch.column(2).type.value_type
            for k in range(batch.num_rows):
                s, slots, ds, data = (batch.column(i)[k].as_py() for i in range(4))
                if s != shard:
                    if shard is not None:
                        yield written()
                    shard = s
                    ids = np.full((min(per_shard, total - shard * per_shard), length), PAD, np.uint16)
                    owners = [None] * len(ids)
                at = np.array(slots) - shard * per_shard
                ids[at] = np.frombuffer(_unpack(data), np.uint16).reshape(-1, length)
                for i, d in zip(at.tolist(), ds, strict=True):
                    owners[i] = d
        if shard is not None:
            yield written()

    numbered = made.join(F.broadcast(offsets.select("part", "base")), "part").select((F.col("base") + F.col("start")).alias("start"), "n", "data", "docs")
    routed = numbered.mapInArrow(route, f"shard int, slots array<bigint>, docs array<{kind}>, data binary")
    each = -(-shards // max(tasks or TASKS, shuffle_partitions(spark) if tasks is None else 1))  # shards a task
    dealt = routed.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("shard")
    dealt.mapInArrow(write, index).write.mode("overwrite").parquet(f"{path}/index")
    _write(f"{path}/meta.json", meta)  # last: shards without it aren't whole
    return spark.read.parquet(f"{path}/index")


def _write(uri: str, data) -> None:
    """A file that is there whole or not at all."""
    fs, path = pafs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data if isinstance(data, bytes) else memoryview(np.ascontiguousarray(data)).cast("B"))
    fs.move(own, path)


def read_slots(path: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """Sequences of slots start..stop-1 in training order; reads shards front to back from the first one needed."""
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{root}/meta.json") as f:
        meta = json.loads(f.read())
    per, length = meta["per_shard"], meta["length"]
    stop = meta["sequences"] if stop is None else min(stop, meta["sequences"])
    while start < stop:
        shard = start // per
        with fs.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek((start - shard * per) * 2 * length)
            while start < min(stop, (shard + 1) * per):
                yield np.frombuffer(f.read(2 * length), np.uint16)
                start += 1


def training_order(spark: SparkSession, docs: DataFrame, **options: int) -> DataFrame:
    """Shards of all of `docs` in the shared folder; their index."""
    return materialise(docs, fresh_path(spark, "shards"), **options)
