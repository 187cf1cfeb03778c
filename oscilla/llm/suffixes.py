"""Removal of byte strings that occur more than once, by suffix arrays over groups that may match.

A string of ``size`` bytes (a window) is removed wherever it stands if it also starts anywhere else.
A suffix array of the whole corpus would meet in one task, so windows are first dealt to groups such
that equal windows always meet:

* The k-gram with the least hash in a window is its anchor.  It depends on the window alone, so equal
  windows have equal anchors at the same place in them.  Windows that start one after the other and
  share an anchor make a piece: the bytes from its first to the end of its last window.
* Pieces of equal content are folded.  If a content occurs twice all of its windows repeat, and nothing
  more has to be looked at.  An anchor that occurs once holds no repeat.
* The distinct contents of an anchor go to one group.  Groups are packed into blocks of bounded bytes,
  and a suffix array of each block finds the windows that repeat.  An anchor with very many distinct
  contents is split instead: each piece into pieces of fewer windows, dealt by the bytes that all of
  these windows share, folded again, and so on; a piece of one window is settled by the folding.

The suffix array is built in two stages.  Suffixes smaller than their successor are sorted directly;
all others follow from these by one scan over the buckets of first bytes, each bucket as a whole.
Adjacent suffixes with at least ``size`` bytes in common are repeats.

Only anchors, positions and the contents that need a closer look are shuffled beside one join that
fetches these contents and one that removes what was found.  The pieces of a common line or passage
share a key; joins deal them to many tasks (``join_dealt``).

Cases: null text counts as empty.  Texts shorter than ``size`` lose nothing, but windows never cross
documents.  A document that is one byte repeated loses all of it.  Rows that repeat an identifier are
rows of their own, so each removes the other's windows.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from oscilla.llm.common import FILE, ROW, on_file, slices, with_locator
from oscilla.session import durable

SIZE, GRAM = 400, 64
CHUNK = 1 << 17  # bytes hashed at once
GROUP = 1_000  # distinct contents of an anchor that one block may hold
BLOCK_BYTES = 4 << 20  # bytes that one task sorts, a part at a time
PART_BYTES = 1 << 19
SPLIT = 8
SHARE = 1_000  # rows of one key that a join gives to one task


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of an odd base and of its inverse."""
    rng = np.random.default_rng(400)
    table = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(CHUNK + SIZE, base, np.uint64))
        down = np.cumprod(np.full(CHUNK + SIZE, pow(base, -1, 1 << 64), np.uint64))
    return table, up, down


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Mixed rolling hash of each k-gram of ``data`` (at most ``CHUNK + SIZE`` bytes)."""
    table, up, down = _powers()
    with np.errstate(over="ignore"):
        sums = np.cumsum(np.append(np.uint64(0), table[data] * up[: len(data)]))
        h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def window_anchors(data: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of each window of ``data``, and the hash of each k-gram; the rightmost of equals."""
    h = gram_hashes(data, gram)
    low = np.uint64((1 << 21) - 1)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    span, reach, least = size - gram + 1, 1, key
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(h) - span + 1], least[span - reach :][: len(h) - span + 1])
    return (low - (least & low)).astype(np.int64), h


def pieces_of(data: np.ndarray, ends: np.ndarray, size: int = SIZE, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Document, start in ``data``, number of windows, distance from the start to the anchor, and hash of the
    anchor of the pieces; documents end at ``ends``."""
    for at in range(0, max(len(data) - size + 1, 0), CHUNK):
        part = data[at : at + CHUNK + size - 1]
        anchor, h = window_anchors(part, size, gram)
        # windows that cross the end of a document are none
        valid = np.ones(len(anchor), bool)
        for e in ends[np.searchsorted(ends, at + 1) : np.searchsorted(ends, at + len(part)) + 1].tolist():
            valid[max(0, e - size + 1 - at) : max(0, e - at)] = False
        begin = np.flatnonzero(valid)
        if not len(begin):
            continue
        anchor = anchor[begin]
        begin += at
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (np.diff(begin) > 1)))
        doc = np.searchsorted(ends, begin[first], side="right")
        lead = anchor[first] + at - begin[first]
        yield doc, begin[first], np.diff(np.append(first, len(begin))), lead, h[anchor[first]]


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the one that starts a byte later; the empty one is least."""
    n = len(data)
    differs = np.flatnonzero(data[:-1] != data[1:])
    nxt = np.searchsorted(differs, np.arange(n))
    out = np.zeros(n, bool)
    some = nxt < len(differs)
    at = differs[nxt[some]]
    out[some] = data[at] < data[at + 1]
    return out


def suffix_array(raw: bytes, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least, by two-stage sorting."""
    data = np.frombuffer(raw, np.uint8)
    small = smaller_than_next(data)
    chosen = np.flatnonzero(small).tolist()
    ordered = np.array(sorted(chosen, key=lambda i: raw[i : i + depth]), np.int64)
    bounds = np.searchsorted(data[ordered], np.arange(257)) if len(ordered) else np.zeros(257, np.int64)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(places: np.ndarray) -> None:
        """Put the larger predecessors of sorted suffixes at the end of what their buckets have."""
        before = places[places > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        heads = data[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
        for a, b in zip(cuts, [*cuts[1:], len(heads)], strict=True):
            induced[heads[a]].append(before[a:b])

    if len(data):
        induce(np.array([len(data)]))
    for c in range(256):
        done = 0
        while done < len(induced[c]):  # what a bucket adds to itself is taken in turn
            wave = np.concatenate(induced[c][done:])
            done = len(induced[c])
            induce(wave)
            out.append(wave)
        sorted_here = ordered[bounds[c] : bounds[c + 1]]
        if len(sorted_here):
            induce(sorted_here)
            out.append(sorted_here)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_starts(contents: list[bytes], windows: list[int], size: int = SIZE) -> list[np.ndarray]:
    """Of each content, which of its first ``windows`` windows occur twice among all of them.

    0xFF, which UTF-8 never has, parts the contents.
    """
    raw = b"\xff".join(contents) + b"\xff"
    begin = np.cumsum([0, *[len(c) + 1 for c in contents[:-1]]])
    is_start = np.zeros(len(raw), bool)
    for b, n in zip(begin.tolist(), windows, strict=True):
        is_start[b : b + n] = True
    order = suffix_array(raw, size)
    order = order[is_start[order]].tolist()
    hit = np.zeros(len(raw), bool)
    last = b""
    for k, i in enumerate(order):
        own = raw[i : i + size]
        if own == last:
            hit[i] = hit[order[k - 1]] = True
        last = own
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begin.tolist(), windows, strict=True)]


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and number of each run of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.append(True, np.diff(starts) > 1))
    return list(zip(starts[cut].tolist(), np.diff(np.append(cut, len(starts))).tolist(), strict=True))


PIECE = f"{FILE} string, {ROW} long, start long, n int, lead int, anchor long, content long"
COLUMNS = [(FILE, pa.string()), (ROW, pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("lead", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64())]


def find_pieces(docs: DataFrame, text: str, size: int, gram: int) -> DataFrame:
    """All pieces of all documents: locator, start, number of windows, anchor and content hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices([t or "" for t in texts]):
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
                raw = b"".join(raws)
                ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
                for doc, begin, n, lead, h in pieces_of(np.frombuffer(raw, np.uint8), ends, size, gram):
                    content = [xxh3_64_intdigest(raw[s : s + k]) for s, k in zip(begin.tolist(), (n + size - 1).tolist(), strict=True)]
                    take = pa.array(doc + a)
                    origin = np.append(0, ends)[doc]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array(begin - origin), pa.array(n.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(np.array(content, np.uint64).view(np.int64))],
                        [name for name, _ in COLUMNS],
                    )

    return with_locator(docs).select(FILE, ROW, text).mapInArrow(run, PIECE)


def fetch(docs: DataFrame, pieces: DataFrame, text: str, size: int) -> DataFrame:
    """``pieces`` with their ``bytes``, cut from the documents they stand in."""
    wanted = pieces.groupBy(FILE, ROW).agg(F.collect_list(F.struct("start", "n", "lead", "anchor", "content", "single", "crowd")).alias("p"))
    held = with_locator(docs).select(FILE, ROW, F.col(text).alias("text")).join(wanted, [FILE, ROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, rows, texts = (batch.column(i).to_pylist() for i in range(3))
            for f, r, t, ps in zip(files, rows, texts, batch.column(3).to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                yield pa.RecordBatch.from_pylist(
                    [{FILE: f, ROW: r, **p, "bytes": raw[p["start"] : p["start"] + p["n"] + size - 1]} for p in ps], schema=layout
                )

    layout = pa.schema([*COLUMNS, ("single", pa.bool_()), ("crowd", pa.bool_()), ("bytes", pa.binary())])
    return held.mapInArrow(run, f"{PIECE}, single boolean, crowd boolean, bytes binary")


def sort_groups(pieces: DataFrame, size: int) -> DataFrame:
    """Runs of repeated windows in the pieces that occur once, block by block."""
    total = pieces.agg(F.sum(F.length("bytes"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come ordered by anchor, so a part ends only where an anchor does
        held: list[dict] = []
        volume, last = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if volume >= PART_BYTES and row["anchor"] != last:
                    yield sort_part(held, size)
                    held, volume = [], 0
                held.append(row)
                volume += len(row["bytes"])
                last = row["anchor"]
        if held:
            yield sort_part(held, size)

    dealt = pieces.repartition(blocks, "anchor").sortWithinPartitions("anchor")
    return dealt.select(FILE, ROW, "start", "n", "anchor", "single", "bytes").mapInArrow(run, f"{FILE} string, {ROW} long, start long, n int")


def sort_part(rows: list[dict], size: int) -> pa.RecordBatch:
    found = []
    for row, starts in zip(rows, repeated_starts([r["bytes"] for r in rows], [r["n"] for r in rows], size), strict=True):
        if row["single"]:
            found += [(row[FILE], row[ROW], row["start"] + s, k) for s, k in runs(starts)]
    columns = list(zip(*found, strict=True)) or [[], [], [], []]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [FILE, ROW, "start", "n"])


def split_pieces(pieces: DataFrame, step: int, size: int) -> DataFrame:
    """Pieces of at most ``step`` windows, cut at multiples of ``step`` from the anchor.

    They are dealt by a hash of the bytes that all windows between two cuts share, which stand in a
    piece that has only some of these windows too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw, lead, n = row["bytes"], row["lead"], row["n"]
                for cell in range(-lead // step, (n - 1 - lead) // step + 1):
                    a, b = max(0, cell * step + lead), min(n, (cell + 1) * step + lead)
                    part = raw[a : b + size - 1]
                    shared = raw[(cell + 1) * step + lead - 1 : cell * step + lead + size]
                    out.append({**row, "start": row["start"] + a, "n": b - a, "lead": lead - a, "anchor": _signed(shared, cell & 0xFFFF), "content": _signed(part), "bytes": part})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=layout)

    layout = pa.schema([*COLUMNS, ("single", pa.bool_()), ("bytes", pa.binary())])
    return pieces.select(FILE, ROW, "start", "n", "lead", "single", "bytes").mapInArrow(run, f"{PIECE}, single boolean, bytes binary")


def _signed(raw: bytes, seed: int = 0) -> int:
    h = xxh3_64_intdigest(raw, seed)
    return h - (1 << 64) if h >> 63 else h


def join_dealt(rows: DataFrame, keys: DataFrame, on: list[str], place: list[str], times: str = "times") -> DataFrame:
    """``rows`` joined with the stored ``keys``, whose column ``times`` is the number of rows of a key.

    A key with more than ``SHARE`` rows goes to several parts, and its rows are dealt to them by ``place``.
    Only such keys are broadcast, less than one for every ``SHARE`` rows.
    """
    parts = F.ceil(F.col(times) / SHARE)
    common = keys.filter(F.col(times) > SHARE).select(*on, parts.alias("_parts"))
    part = F.pmod(F.xxhash64(*place), F.coalesce("_parts", F.lit(1).cast("long")))
    dealt = rows.join(F.broadcast(common), on, "left").withColumn("_part", part).drop("_parts")
    held = keys.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.join(held, [*on, "_part"]).drop("_part")


def settle(pieces: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Pieces whose content occurs twice, and one piece of each other-wise contested content.

    A content is contested if its anchor has another one.  ``single``: it occurs once; ``crowd``: its
    anchor has more than ``group`` contents.
    """
    extra = ["bytes"] if "bytes" in pieces.columns else []
    own = F.first("single") if "single" in pieces.columns else F.lit(True)
    first = F.min_by(F.struct(FILE, ROW, "start", "n", "lead", *extra), F.struct(FILE, ROW, "start"))
    contents = durable(pieces.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("times"), first.alias("p"), own.alias("own")))
    twice = contents.filter("times > 1").select("anchor", "content", "times")
    repeated = join_dealt(pieces, twice, ["anchor", "content"], [FILE, ROW, "start"]).select(FILE, ROW, "start", "n")
    sizes = durable(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1"))
    contested = join_dealt(contents, sizes, ["anchor"], ["content"], "contents").select(
        "p.*", "anchor", "content", ((F.col("times") == 1) & F.col("own")).alias("single"), (F.col("contents") > group).alias("crowd")
    )
    return repeated, contested


def repeated_windows(docs: DataFrame, text: str = "text", size: int = SIZE, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Runs (locator, ``start``, ``n``) of window starts whose window starts elsewhere too."""
    pieces = durable(find_pieces(docs, text, size, gram))
    anchors = durable(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
    live = durable(join_dealt(pieces, anchors, ["anchor"], [FILE, ROW, "start"]).drop("times"))
    repeated, contested = settle(live, group)
    found = [repeated]
    held, step = durable(fetch(docs, contested, text, size)), size
    while True:
        found.append(sort_groups(held.filter("NOT crowd"), size))
        crowd = held.filter("crowd")
        if crowd.isEmpty():
            break
        step = -(-step // SPLIT)
        parts = durable(split_pieces(crowd, step, size))
        repeated, contested = settle(parts, group)
        found.append(repeated)
        held = durable(contested)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove_repeats(docs: DataFrame, text: str = "text", ident: str = "doc_id", size: int = SIZE, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes ``kept`` of every document."""
    docs = on_file(docs)
    spans = durable(
        repeated_windows(docs, text, size, gram, group).groupBy(FILE, ROW).agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + (size - 1)).alias("stop"))).alias("spans"))
    )
    rows = with_locator(docs).select(FILE, ROW, F.col(ident).alias("id"), F.col(text).alias("text")).join(spans, [FILE, ROW], "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, counts, kept = [], [], [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, merged = (t or "").encode("utf-8", "surrogatepass"), []
                for s in sorted((s["start"], s["stop"]) for s in spans or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                edges = [0, *[e for s in merged for e in s], len(raw)]
                sizes.append(len(raw))
                gone.append(sum(b - a for a, b in merged))
                counts.append(len(merged))
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    schema = StructType().add("id", rows.schema["id"].dataType).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return rows.mapInArrow(run, schema)


def brute_force(texts: list[bytes], size: int = SIZE) -> list[list[tuple[int, int]]]:
    """Removed spans of each text, found by counting every window; for tests."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - size + 1):
            w = hashlib.blake2b(t[i : i + size]).digest()
            count[w] = count.get(w, 0) + 1
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if count[hashlib.blake2b(t[i : i + size]).digest()] > 1:
                covered[i : i + size] = True
        out.append([(a, a + n) for a, n in runs(np.flatnonzero(covered))])
    return out
