"""Near copies by similarity: fingerprint groups first, then an exact prefix filter, verified on word shingles.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 differ in about 10 of 64 SimHash
bits.  The generalised pigeonhole is exact at any radius, but at that one its candidates grow with the
square of the documents.  So the groups of ``simhash.links`` at a small radius are a first source of
candidates here, which joins what is almost equal, and a prefix filter finds the rest exactly.

Shingles have one order for the whole corpus, rare ones first.  Two sets of the similarity s share a shingle
among the first n - ceil(s * n) + 1 of both, so only those are posted, and a passage that many texts share is
frequent and stays out of them.  How frequent a shingle is comes from counts in a table of fixed size; the
order is only approximately that of the true counts, and any order gives the same groups.  The
places of the shared shingle and the sizes bound the overlap, and pairs below the bound are no candidates.

Short lists of postings are compared pair by pair.  Large groups of like texts share their prefixes.  Members
of one group need one verified link only, so a list is settled when all its members are in one group.  In
crowded lists a hub, the most
typical set, is compared with the members of other groups first, round by round; then the members outside a list's
largest group are compared with all members of other groups that the bound allows.  A pair that shares several crowded
lists meets in the first of them only.

Texts with the same set are folded to one first.  Every candidate is verified by the exact similarity on the
sets, read from the texts again.  So every pair of at least the similarity ends in one group, and every group
hangs together by such pairs.

Cases: texts with fewer words than a shingle are one shingle.  Null and empty texts and texts without
words have the same, empty set, so one of them stays.  A null identifier gives way to any other; of rows
that repeat an identifier the one that comes first in the files stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from oscilla.llm.common import FILE, ROW, on_file, with_locator
from oscilla.llm.components import components
from oscilla.llm.simhash import links, majority, shingle_hashes
from oscilla.session import durable

SALTS = 32  # parts that the members of one candidate set are dealt to
CROWD = 32  # members of a list, or outside its largest group, above which hubs come before pairs
BLOCK_ROWS = 1_000  # members of a list that are compared in one part
STEP = 200  # texts that a kernel works on at a time
CELL_BITS, CHUNK_BITS = 20, 8  # cells of the table of counts, and chunks in which it is added up


def set_mark(bag: np.ndarray) -> int:
    """Signed hash of a set of shingles."""
    from xxhash import xxh64_intdigest

    return int(np.array([xxh64_intdigest(bag.tobytes(), 42)], np.uint64).view(np.int64)[0])


def cell_of(bag: np.ndarray) -> np.ndarray:
    return (bag >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def marked_sets(rows: DataFrame, words: int) -> DataFrame:
    """For the text in the last column: ``bag`` (a hash of the set), its size ``n`` and ``fp``.

    Each task adds rows with a ``chunk``: its part of the table of counts, ``cells``.
    """
    last = len(rows.columns) - 1
    given = [StructField(f.name, f.dataType) for f in rows.schema.fields[:last]]  # null in the rows of counts
    schema = StructType([*given, *StructType.fromDDL("bag long, n int, fp long, chunk int, cells array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, kinds = np.zeros(1 << CELL_BITS, np.int64), None
        for batch in batches:
            kinds = [c.type for c in batch.columns[:last]]
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                marks, sizes, prints, met = [], [], [], []
                for text in part.column(last):
                    hashes = shingle_hashes(text.as_py(), words)
                    bag = np.unique(hashes)
                    met.append(cell_of(bag))
                    marks.append(set_mark(bag))
                    sizes.append(len(bag))
                    prints.append(majority(hashes))
                cells += np.bincount(np.concatenate(met), minlength=len(cells)) if met else 0
                made = [pa.array(marks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64))]
                empty = [pa.nulls(len(marks), pa.int32()), pa.nulls(len(marks), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:last], *made, *empty], schema.names)
        if kinds is not None:
            table = np.minimum(cells, np.iinfo(np.int32).max).astype(np.int32).reshape(1 << CHUNK_BITS, -1)
            blank = [pa.nulls(len(table), t) for t in [*kinds, pa.int64(), pa.int32(), pa.int64()]]
            yield pa.RecordBatch.from_arrays(
                [*blank, pa.array(np.arange(len(table), dtype=np.int32)), pa.array(list(table), pa.list_(pa.int32()))], schema.names
            )

    return rows.mapInArrow(run, schema)


def commonness(marked: DataFrame) -> np.ndarray:
    """A level for each cell that grows with the shingles counted in it; a table of fixed size for the driver."""

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        whole = np.sum(np.stack(parts["cells"].to_numpy()).astype(np.int64), axis=0)
        levels = np.minimum(4 * np.log2(whole + 1), 255).astype(np.int32)
        return pd.DataFrame({"chunk": [parts["chunk"].iloc[0]], "levels": [levels]})

    summed = marked.filter("chunk IS NOT NULL").select("chunk", "cells").groupBy("chunk").applyInPandas(add, "chunk int, levels array<int>")
    out = np.zeros((1 << CHUNK_BITS, 1 << (CELL_BITS - CHUNK_BITS)), np.uint8)
    for r in summed.collect():
        out[r["chunk"]] = r["levels"]
    return out.ravel()


def prefix_length(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def prefixes(rows: DataFrame, words: int, similarity: float, levels: np.ndarray) -> DataFrame:
    """Postings of the texts in the only column: ``key`` (a shingle), ``bag``, ``n`` and its place ``pos`` in the order."""
    sent = rows.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                keys, marks, sizes = [], [], []
                for text in batch.column(0).slice(a, STEP):
                    bag = np.unique(shingle_hashes(text.as_py(), words))
                    if not len(bag):
                        continue
                    first = np.lexsort((bag, level[cell_of(bag)]))[: prefix_length(len(bag), similarity)]
                    keys.append(bag[first].view(np.int64))
                    marks.append(set_mark(bag))
                    sizes.append(len(bag))
                if keys:
                    counts = np.array([len(k) for k in keys])
                    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    columns = [np.concatenate(keys), np.repeat(marks, counts), np.repeat(sizes, counts).astype(np.int32), place.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "bag", "n", "pos"])

    return rows.mapInArrow(run, "key long, bag long, n int, pos int")


def shared_postings(rows: DataFrame, words: int, similarity: float, levels: np.ndarray) -> DataFrame:
    """The postings of shingles that several sets have in their prefix; the others, nearly all, are shuffled once and go."""
    alike = Window.partitionBy("key")
    posted = prefixes(rows, words, similarity, levels).withColumns({"_lo": F.min("bag").over(alike), "_hi": F.max("bag").over(alike)})
    return durable(posted.filter("_lo < _hi").drop("_lo", "_hi").distinct())


def may_reach(similarity: float, n: Column, pos: Column, other_n: Column, other_pos: Column) -> Column:
    """Whether two sets whose first common shingle has these places can overlap enough."""
    needed = F.ceil(F.lit(similarity / (1 + similarity)) * (n + other_n) - 1e-9)
    return F.least(n - pos, other_n - other_pos) >= needed


def members(rows: DataFrame, words: int) -> DataFrame:
    """For the text in the last of two columns: its set as the array ``members``."""
    schema = StructType([rows.schema.fields[0], *StructType.fromDDL("members array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], schema.names)

    return rows.mapInArrow(run, schema)


def fingerprint_pairs(bags: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Pairs ``a``, ``b`` of the least set and each other one of a group of fingerprints in the radius."""
    fps = durable(bags.filter("n > 0").groupBy("fp").agg(F.min("bag").alias("least")))
    named = fps.join(components(links(fps.select("fp"), radius)).withColumnRenamed("node", "fp"), "fp", "left")
    named = durable(named.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    heads = named.groupBy("root").agg(F.min("least").alias("a"))
    pairs = bags.filter("n > 0").select("fp", F.col("bag").alias("b")).join(named.join(heads, "root").select("fp", "a"), "fp").select("a", "b")
    return alike_in_size(bags, pairs.filter("a <> b").distinct(), similarity)


def alike_in_size(bags: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` whose sizes allow the similarity."""
    sizes = bags.select("bag", "n")
    sized = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return sized.filter(F.least("na", "nb") / F.greatest("na", "nb") >= similarity).select("a", "b")


def unsettled(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``met`` in lists of several groups: their ``root``, the list's largest group ``top``, rows ``c`` and rows ``out`` side ``top``."""
    named = durable(met.join(roots.withColumnRenamed("node", "bag"), "bag", "left").withColumn("root", F.coalesce("root", "bag")))
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("t"), F.sum("m").alias("c"))
    open_ = sizes.filter(F.col("t.m") < F.col("c")).select("key", F.col("t.root").alias("top"), "c", (F.col("c") - F.col("t.m")).alias("out"))
    return durable(named.join(open_, "key"))


def first_shared(similarity: float, other: str) -> Column:
    """Whether a row and another one of its list, prefixed ``other``, may be like enough and share no earlier crowded list."""
    reach = may_reach(similarity, F.col("n"), F.col("pos"), F.col(f"{other}n"), F.col(f"{other}pos"))
    return (F.col("root") != F.col(f"{other}root")) & reach & ~F.arrays_overlap("earlier", f"{other}earlier")


def prefixed(rows: DataFrame, prefix: str, *same: str) -> DataFrame:
    """The columns that a pair of rows of a list is judged by, under other names."""
    return rows.select("key", *same, *[F.col(c).alias(f"{prefix}{c}") for c in ("bag", "n", "pos", "root", "earlier")])


def hub_pairs(left: DataFrame, turn: int, similarity: float) -> DataFrame:
    """The next hub of each crowded list, with the members of other groups that the bound allows.

    Hubs are taken in the order of the place of the list's shingle: a set with few rare shingles of its own is
    the most typical one, and the others are likeliest to be like it.  A set that is the hub of one list is
    compared in all its lists, so that a pair meets in the first list that it shares.
    """
    crowded = left.filter(F.col("out") > CROWD)
    order = Window.partitionBy("key").orderBy("pos", F.xxhash64("bag"), "bag")
    ranked = crowded.select("key", "bag", F.row_number().over(order).alias("_turn")).filter(F.col("_turn") <= turn + 1)
    hubs = prefixed(crowded.join(ranked.filter(F.col("_turn") == turn + 1).select("bag").distinct(), "bag"), "_")
    return crowded.join(hubs, "key").filter(first_shared(similarity, "_")).select(F.col("_bag").alias("a"), F.col("bag").alias("b")).distinct()


def pairs_within(short: DataFrame, similarity: float) -> DataFrame:
    """All pairs of members of short lists that the bound allows."""
    other = short.select("key", *[F.col(c).alias(f"_{c}") for c in ("bag", "n", "pos")])
    near = may_reach(similarity, F.col("n"), F.col("pos"), F.col("_n"), F.col("_pos"))
    return short.join(other, "key").filter((F.col("bag") < F.col("_bag")) & near).select(F.col("bag").alias("a"), F.col("_bag").alias("b"))


def pairs_across(left: DataFrame, similarity: float) -> DataFrame:
    """All pairs of members of a list that are in different groups and that the bound allows, each in the first list that it shares."""
    parts = F.ceil(F.col("c") / BLOCK_ROWS)
    every = prefixed(left.withColumn("part", F.pmod(F.xxhash64("bag"), parts)), "_", "part")
    outside = left.filter("root <> top").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    met = outside.join(every, ["key", "part"]).filter(first_shared(similarity, "_"))
    return met.select(F.least("bag", "_bag").alias("a"), F.greatest("bag", "_bag").alias("b")).distinct()


def sets_of(docs: DataFrame, bags: DataFrame, wanted: DataFrame, words: int, text: str) -> DataFrame:
    """``bag`` and ``members`` of the ``wanted`` sets, read from the texts that stand for them; the texts are shuffled once."""
    needed = wanted.distinct().join(bags.select("bag", F.col("head")[FILE].alias(FILE), F.col("head")[ROW].alias(ROW)), "bag")
    texts = with_locator(docs).select(FILE, ROW, F.col(text).alias("text")).join(needed.hint("merge"), [FILE, ROW])
    return durable(members(texts.select("bag", "text"), words))


def similar_pairs(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` whose sets are as similar as asked."""
    salted = pairs.withColumn("salt", F.pmod("b", F.lit(SALTS)))
    left = salted.join(sets.toDF("b", "mb").hint("merge"), "b")
    right = salted.select("a", "salt").distinct().join(sets.toDF("a", "ma").hint("merge"), "a")
    both = F.size(F.array_intersect("ma", "mb"))
    met = left.join(right.hint("merge"), ["a", "salt"]).select("a", "b", both.alias("both"), (F.size("ma") + F.size("mb") - both).alias("either"))
    return met.filter(F.col("both") / F.col("either") >= similarity).select("a", "b")


def settled_roots(docs: DataFrame, bags: DataFrame, levels: np.ndarray, words: int, similarity: float, radius: int, text: str) -> DataFrame:
    """``node`` and ``root`` of all sets with a link; no list of postings is left with two of them not compared or in one group."""
    met = shared_postings(docs.select(text), words, similarity, levels)
    lists = met.join(met.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "key")
    short = lists.filter(F.col("c") <= CROWD)
    before_it = Window.partitionBy("bag").orderBy("pos", "key").rowsBetween(Window.unboundedPreceding, -1)
    met = durable(lists.filter(F.col("c") > CROWD).drop("c").withColumn("earlier", F.collect_list("key").over(before_it)))
    near = durable(fingerprint_pairs(bags, similarity, radius).unionByName(pairs_within(short, similarity)).distinct())
    wanted = met.select("bag").unionByName(near.select(F.explode(F.array("a", "b")).alias("bag")))
    sets = sets_of(docs, bags, wanted, words, text)

    def verified(pairs: DataFrame) -> DataFrame:
        return durable(similar_pairs(sets, durable(pairs), similarity))

    found = verified(near)
    left, before, turn = unsettled(met, components(found)), None, 0
    while True:
        crowded = left.filter((F.col("out") > CROWD) & (F.col("root") != F.col("top"))).count()
        # hubs are only worth a round while they settle some; what they leave is compared pair by pair
        if not crowded or (before is not None and crowded > 0.9 * before):
            break
        found = found.unionByName(verified(hub_pairs(left, turn, similarity)))
        left, before, turn = unsettled(left.select(met.columns), components(found)), crowded, turn + 1
    return components(found.unionByName(verified(pairs_across(left, similarity))))


def near_copy_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: locator, ``id``, ``component_id`` (identifier of the row that stays) and ``kept``."""
    docs = on_file(docs)
    placed = with_locator(docs).select(FILE, ROW, F.col(ident).alias("id"), F.col(text).alias("text"))
    made = durable(marked_sets(placed, words))
    levels, marked = commonness(made), made.filter("chunk IS NULL").drop("chunk", "cells")
    best = F.min(F.struct(F.col("id").isNull().alias("z"), "id", FILE, ROW))
    bags = durable(marked.groupBy("bag").agg(best.alias("head"), *[F.first(c).alias(c) for c in ("n", "fp")]))
    roots = settled_roots(docs, bags, levels, words, similarity, radius, text).withColumnRenamed("node", "bag")
    named = bags.select("bag", "head").join(roots, "bag", "left").select("bag", "head", F.coalesce("root", "bag").alias("root"))
    heads = named.groupBy("root").agg(F.min("head").alias("head"))
    by_bag = named.select("bag", "root").join(heads, "root").select("bag", "head")
    here = (F.col(FILE) == F.col("head")[FILE]) & (F.col(ROW) == F.col("head")[ROW])
    return marked.select(FILE, ROW, "id", "bag").join(by_bag, "bag").select(FILE, ROW, "id", F.col("head.id").alias("component_id"), here.alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` with one document, that of the smallest identifier, of each group."""
    docs = on_file(docs)
    dropped = durable(near_copy_groups(docs, words, similarity, radius, text, ident).filter(~F.col("kept")).select(FILE, ROW))
    return with_locator(docs).join(dropped.hint("merge"), [FILE, ROW], "left_anti").select(docs.columns)
