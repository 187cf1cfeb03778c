"""Near-duplicate groups by SimHash fingerprints and the generalised pigeonhole principle.

Fingerprints are folded to distinct values first, so exact and identical copies cost one row.  Bits
that agree or disagree together are put into the same partition.  If two fingerprints differ in at
most r bits and the m partitions get thresholds t_i that sum to r - m + 1 (a threshold of -1 leaves a
partition out), some partition differs in at most t_i bits.  Dynamic programming deals out the
thresholds by the estimated number of candidates, for each m tried, and the cheapest plan is taken.

Probing: a partition with an even threshold emits every variant of its bits with t_i / 2 flips, one
with an odd threshold also leaves one bit out, so that two fingerprints share a key exactly if the
partition differs in at most t_i bits.  Buckets of a bounded size verify their pairs.  Members of
larger buckets instead emit every variant of the whole fingerprint with r / 2 flips; fingerprints that
share such a variant differ in at most r bits, so each is linked to the least of them, without pairs.
Links become groups by the alternation of large and small stars.

Cases: null and empty texts, and texts without words, have fingerprint zero.  A text of fewer words
than a shingle is one shingle.  Ties of a bit give zero.  A null identifier never names a group unless
all of the group's are null.  Rows that repeat an identifier are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oscilla.llm.common import FILE, ROW, with_locator
from oscilla.llm.components import components
from oscilla.session import durable

BITS = 64
BUCKET = 64  # members of a bucket that are compared in pairs
BLOCK = 100_000  # shingles that a kernel holds at once


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a text, in order and with repeats; empty if there is no word."""
    from xxhash import xxh64_intdigest

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(ws) <= words:
        return np.array([xxh64_intdigest(b" ".join(ws), seed)] if ws else [], np.uint64)
    joined, n = b" ".join(ws), len(ws) - words + 1
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    out = np.empty(n, np.uint64)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        spans = zip(starts[a:b].tolist(), ends[a + words - 1 : b + words - 1].tolist(), strict=True)
        out[a:b] = np.fromiter((xxh64_intdigest(joined[i:j], seed) for i, j in spans), np.uint64, b - a)
    return out


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, unsigned."""
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), BLOCK):
        part = hashes[a : a + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """SimHash of the word shingles of one text, unsigned."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text") -> DataFrame:
    """``docs``' other columns and ``fp``, a signed long with the bits of the fingerprint."""
    rows = docs.select(*[c for c in docs.columns if c != text], F.col(text).alias(text))
    last = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(last)), np.uint64, batch.num_rows)
            kept = [batch.column(i) for i in range(last)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps.view(np.int64))], [*batch.schema.names[:last], "fp"])

    schema = StructType(rows.schema.fields[:last]).add("fp", "long")
    return rows.mapInArrow(run, schema)


def together(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and, for each pair of bits, how many have both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8)
            for part in np.array_split(values.reshape(-1, 8), max(1, len(values) // 800_000)):
                bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        if n:
            counts = np.append(both.ravel(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], ["cell", "n"])

    sums = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    if not sums:
        return 0, np.zeros((BITS, BITS))
    cells = np.zeros(BITS * BITS + 1)
    cells[[r["cell"] for r in sums]] = [r["n"] for r in sums]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def partition_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into ``m`` partitions of near equal size, each grown by the bit most correlated with it."""
    share = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(share, share)
    spread = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    corr = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        first = max(free, key=lambda b: corr[b, free].sum())
        part = [first]
        free.remove(first)
        while len(part) < size:
            nxt = max(free, key=lambda b: corr[b, part].sum())
            part.append(nxt)
            free.remove(nxt)
        out.append(sorted(part))
    return out


def emitted(bits: int, threshold: int) -> int:
    """Keys that a fingerprint emits for a partition."""
    if threshold < 0:
        return 0
    variants = sum(math.comb(bits - threshold % 2, k) for k in range(threshold // 2 + 1))
    return variants * (bits if threshold % 2 else 1)


def candidates(n: int, share: np.ndarray, part: list[int], threshold: int) -> float:
    """Expected number of pairs within ``threshold`` in a partition, from how often each bit is set."""
    if threshold < 0:
        return 0.0
    chance = np.zeros(threshold + 2)
    chance[0] = 1.0
    for p in share[part]:
        differ = 2 * p * (1 - p)
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
        chance[-1] = 0
    return n * (n - 1) / 2 * float(chance[: threshold + 1].sum())


def plan(n: int, both: np.ndarray, radius: int, tried: tuple[int, ...] = (1, 2, 3, 4, 5)) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds: the cheapest allocation by emitted keys and expected candidates."""
    share, best, best_cost = np.diag(both) / max(n, 1), [], math.inf
    for m in tried:
        parts = partition_bits(n, both, m)
        span = range(-1, radius + 1)
        costs = [{t: n * emitted(len(p), t) + candidates(n, share, p, t) for t in span} for p in parts]
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            grown: dict[int, tuple[float, list[int]]] = {}
            for total, (c, ts) in table.items():
                for t in span:
                    if total + t not in grown or c + cost[t] < grown[total + t][0]:
                        grown[total + t] = (c + cost[t], [*ts, t])
            table = grown
        cost, ts = table[radius - m + 1]
        if cost < best_cost:
            best, best_cost = [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0], cost
    return best


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _flips(bits: list[int], flips: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(flips + 1) for c in combinations(bits, k)]


def _variants(own: Column, tag: int, masks: list[int]) -> Column:
    flips = F.array(*[F.lit(x).cast("long") for x in masks])
    return F.transform(flips, lambda x: F.struct(F.lit(tag).alias("part"), own.bitwiseXOR(x).alias("key")))


def probe_keys(fp: Column, parts: list[tuple[list[int], int]]) -> Column:
    """All keys of a fingerprint: the number of the partition (and of the bit left out), and its bits."""
    out = []
    for p, (bits, threshold) in enumerate(parts):
        for drop in bits if threshold % 2 else [-1]:
            left = [b for b in bits if b != drop]
            own = fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in left))))
            out.append(_variants(own, p * 128 + drop + 1, _flips(left, threshold // 2)))
    return F.concat(*out)


def links(fps: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links ``a``, ``b`` between distinct values of ``fp`` whose groups are those of all pairs in the radius."""
    if radius % 2:
        raise ValueError("the radius must be even")
    parts = plan(*together(fps), radius)
    if not parts:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    keyed = fps.select("fp", F.explode(probe_keys(F.col("fp"), parts)).alias("k")).select("fp", "k.part", "k.key")
    sizes = keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = durable(keyed.join(sizes, ["part", "key"]))
    small = met.filter(F.col("n") <= bucket).groupBy("part", "key").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    pairs = F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y > x) & close(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    verified = small.select(F.explode(F.flatten(pairs)).alias("p")).select("p.a", "p.b")
    crowd = met.filter(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(*[F.lit(x).cast("long") for x in _flips(list(range(BITS)), radius // 2)])
    near = durable(crowd.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("key")))
    least = near.groupBy("key").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    star = near.join(least, "key").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return verified.unionByName(star).distinct()


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: locator, ``id``, ``fp``, the group's ``component_id`` and ``kept``."""
    placed = with_locator(docs).select(FILE, ROW, F.col(ident).alias("id"), F.col(text).alias("text"))
    marked = durable(fingerprints(placed, words))
    distinct = durable(marked.select("fp").distinct())
    roots = components(links(distinct, radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    best = F.min(F.struct(F.col("id").isNull().alias("z"), "id", FILE, ROW))
    least = marked.groupBy("fp").agg(best.alias("b")).join(named, "fp")
    heads = least.groupBy("root").agg(F.min("b").alias("head"))
    by_fp = named.join(heads, "root").select("fp", "head")
    here = (F.col(FILE) == F.col("head")[FILE]) & (F.col(ROW) == F.col("head")[ROW])
    return marked.join(by_fp, "fp").select(FILE, ROW, "id", "fp", F.col("head.id").alias("component_id"), here.alias("kept"))
