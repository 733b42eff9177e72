"""SimHash near-duplicates through the generalised pigeonhole principle.

Fingerprints are made in Arrow batches from whole texts. Links (at most `radius` differing bits) are then searched among
distinct fingerprints: bits that correlate are grouped into partitions; each partition i gets a threshold T_i >= -1 with
sum(T_i + 1) = radius + 1, chosen by dynamic programming on estimated candidate counts. Two fingerprints within the
radius then differ in at most T_i bits of some partition i, so they share one of the keys "value of partition i less T_i
masked bits". Fingerprints are probed by those keys and verified by their differing bits.

A key shared by more than `bucket` fingerprints isn't expanded into pairs. There each fingerprint is listed under every
value that differs from it in at most one bit the key leaves open: two fingerprints within two bits share such a value,
and all that share one are within two bits, so joining each to the least one is exact. At most 65 fingerprints share a
value, so no task gathers a hot group, and rows stay in proportion to fingerprints whatever the sizes of groups.

Defined results: a null text has no words, and its fingerprint is zero like that of any text without words; a null id
belongs to its component but never names it (a component of null ids alone has a null component_id); repeated rows get
equal rows; an empty table gives an empty result; no column but the id and the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut, joined_rows, one_each, own_columns, text_key
from lattica.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
PARTITIONS = 3
#: The most fingerprints under one key that are compared pair by pair.
BUCKET = 64


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """SimHash of the k-word shingles of a UTF-8 text; A-Z count as lower case."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= k:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False))]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    most = 2 * np.add.reduce(bits, axis=0, dtype=np.int64) > len(hashes)
    return int.from_bytes(np.packbits(most).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp): the 64 bits as a signed long."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py(), k) for x in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "text_key", "fp"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, text_key bigint, fp bigint")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have both bit i and bit j, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype("<u8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            for i in range(0, len(bits), 1 << 20):
                both += bits[i : i + (1 << 20)].T @ bits[i : i + (1 << 20)]
            n += len(bits)
        if n:
            cells = np.concatenate([both.astype(np.int64).ravel(), [n]])
            yield pa.RecordBatch.from_arrays([pa.array(range(4097), pa.int32()), pa.array(cells, pa.int64())], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows at most
    cells = np.zeros(4097)
    for r in rows:
        cells[r.cell] = r.n
    return int(cells[4096]), cells[:4096].reshape(64, 64)


def bit_groups(n: int, both: np.ndarray, parts: int = PARTITIONS) -> list[list[int]]:
    """The 64 bits in `parts` groups of nearly equal width; each group grows by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    rest, groups = set(range(64)), []
    for g in range(parts):
        width = 64 // parts + (g < 64 % parts)
        own = [max(rest, key=lambda i: (corr[i, sorted(rest)].sum(), -i))]
        rest.discard(own[0])
        while len(own) < width:
            own.append(max(rest, key=lambda i: (corr[i, own].sum(), -i)))
            rest.discard(own[-1])
        groups.append(sorted(own))
    return groups


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def allocate(cost: list[list[float]], radius: int = RADIUS) -> list[int]:
    """Thresholds T_i >= -1 with sum(T_i + 1) = radius + 1 of least total cost; cost[i][e] is partition i's at T_i = e."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for units in range(radius + 2 - used):
                option = (total + (c[units - 1] if units else 0.0), [*chosen, units - 1])
                if used + units not in step or option < step[used + units]:
                    step[used + units] = option
        best = step
    return best[radius + 1][1]


def plan(fps: DataFrame, parts: int = PARTITIONS, radius: int = RADIUS) -> list[tuple[int, list[int]]]:
    """The keys to probe: (bits compared as a mask, bits left open) for each partition and choice of masked bits."""
    n, both = bit_statistics(fps)
    groups = bit_groups(n, both, parts)
    values = [fps.select(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("value")) for i, g in enumerate(groups)]
    pairs = dict.fromkeys(range(parts), 0.0)
    for v in values:
        pairs |= {r.part: float(r.pairs or 0) for r in v.groupBy("part", "value").agg(F.count("*").alias("c")).groupBy("part").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs")).collect()}
    p = np.diag(both) / max(n, 1)
    agree = np.maximum(p**2 + (1 - p) ** 2, 0.5)
    cost = []
    for i, g in enumerate(groups):
        odds, row = (1 - agree[g]) / agree[g], []
        poly = [1.0]  # elementary symmetric sums of the odds: differing in 0, 1, ... bits of the partition
        for o in odds:
            poly = [a + o * b for a, b in zip([*poly, 0.0], [0.0, *poly], strict=True)]
        for e in range(radius + 1):
            row.append(pairs[i] * sum(poly[: e + 1]))
        cost.append(row)
    keys = []
    for g, t in zip(groups, allocate(cost, radius), strict=True):
        for masked in combinations(g, t) if t >= 0 else ():
            own = [b for b in g if b not in masked]
            keys.append((_mask(own), [b for b in range(64) if b not in own]))
    return keys


def links(fps: DataFrame, parts: int = PARTITIONS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within two bits, not every pair of them."""
    keys = plan(fps, parts)
    probe = F.array(*[F.struct(F.lit(i).alias("key"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, (m, _) in enumerate(keys)])
    probes = cut(fps.select("fp", F.explode(probe).alias("k")).select("fp", "k.key", "k.value"))
    shared = cut(probes.groupBy("key", "value").agg(F.count("*").alias("n")).filter("n > 1"))
    few = probes.join(shared.filter(F.col("n") <= bucket), ["key", "value"]).select("key", "value", "fp")
    a, b = few.select("key", "value", F.col("fp").alias("a")), few.select("key", "value", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    verified = a.join(b, (a["key"] == b["key"]) & (a["value"] == b["value"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
    open_bits = F.element_at(F.array(*[F.array(F.lit(0), *[F.lit(_mask([x])) for x in o]) for _, o in keys]), F.col("key") + 1)
    many = probes.join(shared.filter(F.col("n") > bucket), ["key", "value"]).select("fp", F.explode(open_bits).alias("flip"))
    around = many.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z")).distinct()
    stars = around.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("z")).alias("b")).filter("a <> b")
    return verified.union(stars)


def clusters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, parts: int = PARTITIONS, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, text_key, fp, root (the least fingerprint it reaches), component_id (the least id)."""
    own = cut(fingerprints(own_columns(docs, doc_id=doc_id, text=text), k=k))
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps.select("fp"), parts, bucket))
    rooted = cut(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut(rooted.join(named, "root").select(F.col("fp").alias("_fp"), "root", "component_id"))
    return own.join(by_fp, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, parts: int = PARTITIONS, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least id it reaches)."""
    return clusters(docs, doc_id, text, k, parts, bucket).select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, parts: int = PARTITIONS, bucket: int = BUCKET) -> DataFrame:
    """The rows of `docs` that stay, one of each component: the one with the least id."""
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = clusters(docs, doc_id, text, k, parts, bucket).groupBy("root").agg(F.min(least).alias("x")).select("x.doc_id", "x.text_key")
    return one_each(joined_rows(docs, first, "left_semi", doc_id, text), doc_id, text)


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
