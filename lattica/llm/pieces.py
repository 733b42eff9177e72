"""SentencePiece encoding with seeded merge dropout, and decoding.

The vocabulary is a SentencePiece BPE model with byte fallback. A text is encoded as the library does it: characters
are merged by an agenda of adjacent pairs, best score first, then leftmost. With dropout, the candidate that comes up in
step t of a chunk is skipped if a keyed hash of (seed, document, place of the chunk in the text, t) falls below the rate;
it is gone then unless a neighbouring merge makes a new candidate. Everything follows from the seed and the document's
id, so runs agree, and each occurrence of a word is cut by draws of its own. Any such cut decodes to the exact text.

No symbol reaches over certain borders (before a space, around characters that no symbol holds), so a text is encoded
in chunks between them. What a chunk gives depends on its skipped steps alone, so a worker remembers a tree for each
chunk that it meets again: its root is the chunk without skips, a node's children are the next step that is skipped. An
occurrence walks down by its own draws; nodes that aren't there yet are made for a whole batch together, in arrays, and
so are chunks that are met for the first time, straight by their draws. Chunks of over SHORT characters are merged one by
one with a heap.

Defined results: a null text has null ids and no tokens, an empty text has no tokens; a null id is a key like any other;
repeated rows get equal rows; an empty table gives an empty result. Memory is bounded by the batch, not by the corpus.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import own_columns

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 17
#: Chunks of up to so many characters are encoded in arrays; their steps, at most 3 (SHORT - 1), are bits of a number.
SHORT = 21
#: Nodes of chunks' trees that a worker keeps from part to part, and characters in a part.
KEPT = 700_000
PART_CHARS = 2_000_000

SPACE = "▁"
LITERAL = "\0▁"
NONE = np.int32(2**31 - 1)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Codec:
    """Encoder and decoder for the model file at `path` (by default a public one, found through its package)."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [b""] * n
        for p, i in self.ids.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        order = sorted(normal, key=lambda i: -sp.get_score(i))
        rank = np.full(n, NONE, np.int32)
        last, at = None, -1
        for i in order:  # equal scores share a rank
            if sp.get_score(i) != last:
                last, at = sp.get_score(i), at + 1
            rank[i] = at
        self.n, self.rank = n, rank
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        self.pairs = pairs
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        with np.errstate(over="ignore"):
            slots = ((np.array(list(pairs), np.uint64) * _M1) >> self.shift).astype(np.int64).tolist()
        for slot, (k, m) in zip(slots, pairs.items(), strict=True):
            while self.slot_key[slot] >= 0:
                slot = (slot + 1) & self.last
            self.slot_key[slot], self.slot_merged[slot] = k, m
        self.chars = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.table = np.full(0x110000, -1, np.int32)
        for p, i in self.chars.items():
            self.table[ord(p)] = i
        crossing = [p for p in self.ids if SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"symbols reach over a space: {crossing[:3]}")
        inside = "".join(sorted({c for p in self.ids for c in p} - {SPACE}))
        inside = "".join(c for c in inside if c in self.chars)
        self.chunk = re.compile(f"{SPACE}*[{re.escape(inside)}]+|{SPACE}+|[^{re.escape(inside)}{SPACE}]")

    # --- text to chunks

    def chunks(self, text: str) -> list[str]:
        """A literal U+2581 is a chunk of its own, LITERAL, and is spelled in bytes, so that it isn't read back as a space."""
        if not text:
            return []
        first, *rest = text.split(SPACE)
        out = self.chunk.findall(SPACE + first.replace(" ", SPACE))
        for part in rest:
            out += [LITERAL, *self.chunk.findall(part.replace(" ", SPACE))]
        return out

    def symbols(self, chunk: str) -> list[int]:
        """Ids of the characters; -1 - code point for one outside the vocabulary."""
        if chunk == LITERAL:
            return [-1 - ord(SPACE)]
        get = self.chars.get
        return [get(c, -1 - ord(c)) for c in chunk]

    def _spelled(self, ids) -> list[int]:
        out = []
        for i in ids:
            out += [i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode()]
        return out

    # --- one chunk by a heap

    def agenda(self, symbols: list[int], key: int, rate: float) -> list[int]:
        """The merged symbols of a chunk whose occurrence has the key."""
        n, ids, step = len(symbols), list(symbols), 0
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        skips = _skipped(key, np.arange(3 * n), rate).tolist() if rate else [False] * (3 * n)  # a merge makes two candidates at most
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and ids[a] >= 0 and ids[b] >= 0:
                m = self.pairs.get(ids[a] * self.n + ids[b])
                if m is not None:
                    heapq.heappush(heap, (int(self.rank[m]), a, ids[a], ids[b], m))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, left, right, m = heapq.heappop(heap)
            b = after[a] if alive[a] else n
            if b >= n or ids[a] != left or ids[b] != right:
                continue
            step += 1
            if skips[step - 1]:
                continue
            ids[a], alive[b], after[a] = m, False, after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [ids[i] for i in range(n) if alive[i]]

    # --- many chunks of one length in arrays

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged symbol of each pair, or -1, from an open-addressed table; a negative symbol merges with nothing."""
        key = a.astype(np.int64) * self.n + b
        with np.errstate(over="ignore"):
            at = ((key.astype(np.uint64) * _M1) >> self.shift).astype(np.intp)
        out = np.where(self.slot_key[at] == key, self.slot_merged[at], np.int32(-1))
        more = np.flatnonzero((self.slot_key[at] != key) & (self.slot_key[at] >= 0))
        while len(more):  # the slot holds another pair: look at the next one
            at[more] = (at[more] + 1) & self.last
            found = self.slot_key[at[more]]
            out[more] = np.where(found == key[more], self.slot_merged[at[more]], np.int32(-1))
            more = more[(found != key[more]) & (found >= 0)]
        out[(a < 0) | (b < 0)] = -1
        return out

    def together(self, symbols: np.ndarray, keys: np.ndarray, rate: float) -> list[bytes]:
        """As `agenda`, for rows of one length of two at least; ids as 32-bit integers in bytes."""
        ids, counts, _ = self.merged(symbols, (lambda row, step: _skipped(keys[row], step, rate)) if rate else None)
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]

    def merged(self, symbols: np.ndarray, skipped) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, how many each row has, and its steps; `skipped` says of rows and their steps which ones are skipped.

        Symbols stay where their first character is; `after` and `before` link those that are left.
        """
        rows, n = symbols.shape
        steps = np.zeros(rows, np.int64)
        sym = symbols.astype(np.int32).ravel()
        after, before = np.tile(np.arange(1, n + 1, dtype=np.int32), rows), np.tile(np.arange(-1, n - 1, dtype=np.int32), rows)
        left = np.ones(rows * n, bool)
        made = np.full((rows, n), -1, np.int32)
        grid = sym.reshape(rows, n)
        made[:, :-1] = self._merge_of(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(rows, n - 1)
        rank = np.where(made >= 0, self.rank[made], NONE)
        made, flat = made.ravel(), rank.ravel()
        row = np.arange(rows)
        while len(row):
            j = (rank if len(row) == rows else rank[row]).argmin(1)
            at = row * n + j
            live = flat[at] != NONE
            if not live.all():
                row, at = row[live], at[live]
            m = made[at]
            steps[row] += 1
            if skipped is not None:
                skip = skipped(row, steps[row] - 1)
                if skip.any():
                    flat[at[skip]] = NONE
                    at, m, start = at[~skip], m[~skip], row[~skip] * n
                else:
                    start = row * n
            else:
                start = row * n
            gone = start + after[at]
            following = after[gone]
            sym[at], left[gone], flat[gone], flat[at], after[at] = m, False, NONE, NONE, following
            inner = following < n
            right = (start + following)[inner]
            before[right] = (at - start)[inner]
            has = before[at] >= 0
            previous = (start + before[at])[has]
            where = np.concatenate([at[inner], previous])
            new = self._merge_of(np.concatenate([m[inner], sym[previous]]), np.concatenate([sym[right], m[has]]))
            made[where], flat[where] = new, np.where(new >= 0, self.rank[new], NONE)
        return sym[left], left.reshape(rows, n).sum(1), steps

    def rows_of(self, chunks: list[str]) -> np.ndarray:
        """Symbols of chunks of one length, of 2 to SHORT characters; these hold no character outside the vocabulary."""
        return self.table[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)].reshape(len(chunks), -1)

    # --- whole texts

    def encode(self, text: str, key: int = 0, rate: float = 0.0) -> list[int]:
        """Ids of one text whose document has the key, chunk by chunk."""
        chunks = self.chunks(text)
        return [i for c, k in zip(chunks, occurrence_keys(np.full(len(chunks), key, np.uint64), np.arange(len(chunks))), strict=True) for i in self._spelled(self.agenda(self.symbols(c), k, rate))]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def occurrence_keys(document: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The keys of chunks at places of texts whose documents have the keys `document`."""
    with np.errstate(over="ignore"):
        return _mix(document ^ _mix((place.astype(np.uint64) + np.uint64(1)) * _M1))


def _skipped(key, step: np.ndarray, rate: float) -> np.ndarray:
    """Whether the keyed hash of a step falls below the rate."""
    with np.errstate(over="ignore"):
        h = _mix(np.asarray(key, np.uint64) + (step.astype(np.uint64) + np.uint64(1)) * _M1)
    return h <= np.uint64(min(int(rate * 2**64), 2**64 - 1))


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    return Codec(path)


class Encoder:
    """Texts to ids; holds the trees of chunks that came again, and those that came once (`seen`), within a bound.

    Node i gives the `count[i]` ids from `ids[start[i]]` on, in `steps[i]` steps; `root[i]` is its chunk, of `size[i]`
    characters, `mask[i]` the steps skipped in it. `child[64 * i + t]` is the node where step t is skipped too.
    """

    def __init__(self, own: Codec, seed: int = SEED, rate: float = DROPOUT, kept: int = KEPT):
        from xxhash import xxh64_intdigest

        self.codec, self.seed, self.rate, self.kept, self.hash = own, seed, rate, kept, xxh64_intdigest
        self._clear()

    def _clear(self) -> None:
        self.chunk: dict[str, int] = {}
        self.seen: set[str] = set()
        self.child: dict[int, int] = {}
        self.root: list[str] = []
        self.n = self.filled = 0
        self.ids, (self.start, self.count, self.size, self.steps) = np.zeros(1 << 17, np.int32), (np.zeros(1 << 16, np.int64) for _ in range(4))
        self.mask = np.zeros(1 << 16, np.uint64)

    def _add(self, n: int) -> int:
        """Room for n more nodes; the first one's number."""
        first, self.n = self.n, self.n + n
        while self.n > len(self.mask):
            for name in ("start", "count", "size", "steps", "mask"):
                own = getattr(self, name)
                setattr(self, name, np.concatenate([own, np.zeros_like(own)]))
        return first

    def _put(self, nodes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        end = self.filled + len(ids)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : end] = ids
        self.start[nodes], self.count[nodes], self.filled = self.filled + np.cumsum(counts) - counts, counts, end

    def _merged(self, first: int, chunks: list[str], skipped) -> np.ndarray:
        """Fills nodes from `first` on with those of `chunks` that go into arrays; `skipped` (places to what `merged` takes).

        Returns the chunks' lengths, 0 for those that don't."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.size[first : first + len(chunks)] = lengths
        lengths[(lengths < 2) | (lengths > SHORT)] = 0
        if LITERAL in chunks:
            lengths[[i for i, c in enumerate(chunks) if c == LITERAL]] = 0
        for n in np.unique(lengths[lengths > 0]).tolist():
            places = np.flatnonzero(lengths == n)
            for part in np.split(places, range(8192, len(places), 8192)):
                ids, counts, self.steps[first + part] = self.codec.merged(self.codec.rows_of([chunks[i] for i in part.tolist()]), skipped(part))
                self._put(first + part, ids, counts)
        return lengths

    def _one(self, node: int, ids: list[int]) -> None:
        self._put(np.array([node]), np.array(ids, np.int32), np.array([len(ids)]))

    def _nodes(self, roots: list[str], masks: np.ndarray) -> None:
        """Adds nodes for chunks with the steps of their masks skipped."""
        first = self._add(len(roots))
        by_mask = lambda own: (lambda row, step: (own[row] >> step.astype(np.uint64)) & np.uint64(1) == 1) if own.any() else None
        lengths = self._merged(first, roots, lambda part: by_mask(masks[part]))
        for i in np.flatnonzero(lengths == 0).tolist():  # no skips here: long chunks' occurrences are merged one by one
            symbols = self.codec.symbols(roots[i])
            found = self.codec.agenda(symbols, 0, 0.0)
            self.steps[first + i] = len(symbols) - len(found)
            self._one(first + i, self.codec._spelled(found))
        self.mask[first : first + len(roots)] = masks
        self.root += roots

    def _children(self, keys: list[int]) -> None:
        """Adds the nodes of child keys."""
        at = [k >> 6 for k in keys]
        masks = self.mask[at] | (np.uint64(1) << (np.array(keys, np.uint64) & np.uint64(63)))
        self.child.update(zip(keys, range(self.n, self.n + len(keys)), strict=True))
        self._nodes([self.root[i] for i in at], masks)

    def _walked(self, node: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The nodes of occurrences of roots `node` by the draws of their keys."""
        node, step = node.copy(), np.zeros(len(node), np.int64)
        going = np.arange(len(node))
        while len(going):
            waiting: list[np.ndarray] = []
            while len(going := going[step[going] < self.steps[node[going]]]):
                skip = _skipped(keys[going], step[going], self.rate)
                step[going] += 1
                off = going[skip]
                if len(off):
                    wanted, place = np.unique(node[off] * 64 + step[off] - 1, return_inverse=True)
                    found = np.fromiter(map(self.child.get, wanted.tolist(), repeat(-1)), np.int64, len(wanted))[place]
                    there = found >= 0
                    node[off[there]] = found[there]
                    if not there.all():
                        waiting.append(off[~there])
                        left = np.ones(len(node), bool)
                        left[off[~there]] = False
                        going = going[left[going]]
            going = np.concatenate(waiting) if waiting else going[:0]
            if len(going):
                wanted, place = np.unique(node[going] * 64 + step[going] - 1, return_inverse=True)
                self._children(wanted.tolist())
                node[going] = np.arange(self.n - len(wanted), self.n)[place]
        return node

    def _found(self, flat: list[str]) -> np.ndarray:
        """The roots of chunks; -1 for one that occurs once here and never did before."""
        node = np.fromiter(map(self.chunk.get, flat, repeat(-1)), np.int64, len(flat))
        if len(unknown := np.flatnonzero(node < 0)):
            chunks = [flat[i] for i in unknown.tolist()]
            times = Counter(chunks)
            once = {c for c, n in times.items() if n == 1 and 1 < len(c) <= SHORT and c != LITERAL}.difference(self.seen) if self.rate else set()
            new = [c for c in times if c not in once]
            self.chunk.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self._nodes(new, np.zeros(len(new), np.uint64))
            node[unknown] = np.fromiter(map(self.chunk.get, chunks, repeat(-1)), np.int64, len(chunks))
            self.seen.difference_update(new)
            self.seen |= once
        return node

    def encode(self, doc_ids: list, texts: list[str | None]) -> list[np.ndarray | None]:
        if self.n + len(self.seen) > self.kept:
            self._clear()
        chunked = [self.codec.chunks(t) if t else [] for t in texts]
        sizes = np.array([len(c) for c in chunked], np.int64)
        flat, ends = list(chain.from_iterable(chunked)), np.cumsum(sizes)
        node = self._found(flat)
        n, filled = self.n, self.filled
        if self.rate and len(flat):
            document = np.repeat(np.array([self.hash(f"{self.seed}:{i}") for i in doc_ids], np.uint64), sizes)
            keys = occurrence_keys(document, np.arange(len(flat)) - np.repeat(ends - sizes, sizes))
            some = np.flatnonzero((node >= 0) & (self.steps[node] > 0))
            long = some[self.size[node[some]] > SHORT]
            some = some[self.size[node[some]] <= SHORT]
            node[some] = self._walked(node[some], keys[some])
            n, filled = self.n, self.filled  # what follows is for these texts alone
            for i in long.tolist():
                if _skipped(keys[i], np.arange(self.steps[node[i]]), self.rate).any():
                    ids = self.codec._spelled(self.codec.agenda(self.codec.symbols(flat[i]), keys[i], self.rate))
                    node[i] = self._add(1)
                    self._one(node[i], ids)
            once = np.flatnonzero(node < 0)
            first, own = self._add(len(once)), keys[once]
            draws = lambda part: lambda row, step, k=own[part]: _skipped(k[row], step, self.rate)
            self._merged(first, [flat[i] for i in once.tolist()], draws)
            node[once] = np.arange(first, self.n)
        counts = self.count[node]
        upto = np.cumsum(counts)
        ids = self.ids[np.repeat(self.start[node] - upto + counts, counts) + np.arange(upto[-1] if len(upto) else 0)]
        self.n, self.filled = n, filled
        cuts = np.concatenate([[0], upto])[np.concatenate([[0], ends])]
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(model: str | None, seed: int, rate: float) -> Encoder:
    """One for each worker process, which keeps it from task to task; what it holds never changes a result."""
    return Encoder(codec(model), seed, rate)


def _parts(texts: list[str | None], most: int = PART_CHARS) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = DROPOUT, seed: int = SEED, model: str | None = None) -> DataFrame:
    """doc_id, ids (null for a null text), n_tokens, lossless (the ids decode to the very text; null for a null text)."""
    own = own_columns(docs, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, own_encoder = codec(model), encoder(model, seed, rate)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _parts(texts):
                part, own_keys = texts[a:b], keys.slice(a, b - a)
                ids = own_encoder.encode(own_keys.to_pylist(), part)
                same = [None if t is None else c.decode(i.tolist()) == t for i, t in zip(ids, part, strict=True)]
                counts = np.array([0 if i is None else len(i) for i in ids], np.int64)
                values = np.concatenate([np.zeros(0, np.int32), *(i for i in ids if i is not None)])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([i is None for i in ids] + [False]))
                lists = pa.ListArray.from_arrays(offsets, pa.array(values))
                yield pa.RecordBatch.from_arrays([own_keys, lists, pa.array(counts), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "lossless"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens bigint, lossless boolean")


def decode(encoded: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """`encoded` with the column `text` that its ids spell (null for null ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            at = batch.schema.get_field_index("_ids")
            texts = [None if x is None else c.decode(x) for x in batch.column(at).to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*(x for x in batch.schema.names if x != "_ids"), "text"])

    others = encoded.drop("text")
    schema = others.schema.add("text", "string")
    return others.withColumn("_ids", F.col(ids)).mapInArrow(run, schema)
