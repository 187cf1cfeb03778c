"""Text operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty
tables and further columns with clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from oscilla.llm import bpe, components, exact_dedup, line_dedup, mixing, near_copies, packing, quality, simhash, suffixes, token_count, topk, toxicity
from oscilla.llm.common import hash_sample, held_fold
from oscilla.llm.queries import END_ID, tokenizer_path
from oscilla.session import ship_package

SCHEMA = (
    StructType()
    .add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string")
    # names that the operators use inside
    .add("id", "string").add("kept", "integer").add("digest", "string").add("fp", "string").add("tokens", "string").add("start", "string")
)
LONG = "lorem ipsum dolor\n" * 4000
ROWS = [
    (1, "a b c", "en", "s1"),
    (2, " a  b\tc\n", "en", "s1"),
    (3, "abc", "en", None),
    (4, None, None, "s2"),
    (5, "", "en", "s2"),
    (6, " \n ", "en", "s2"),
    (None, "no name", "en", "s1"),
    (None, "no name", "en", "s1"),
    (7, "twice", "en", "s1"),
    (7, "twice", "en", "s1"),
    (8, LONG, "en", "s3"),
    (9, "one\ntwo\nthree\nfour", "en", "s1"),
    (10, "zero\none\ntwo\nthree", "en", "s1"),
    (11, "\n\n\n\n", "en", "s1"),
    (12, "I'll say <|endoftext|> é 中  x\r\n", "en", "s1"),
]
CLASH = (None, 3, "x", "y", "z", "w")


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame([(*r, *CLASH) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(rng, n, pool=40):
    return " ".join(f"w{rng.randint(0, pool)}" for _ in range(n))


# exact dedup


def blankless(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_groups(docs):
    got = exact_dedup.exact_groups(docs).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[blankless(t)].append((-len(t or ""), i is None, i or 0, i))
    assert len(got) == len(ROWS)
    want = {hashlib.sha256(k.encode()).digest(): (min(v)[3], len(v)) for k, v in groups.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[bytes(r["digest"])]
    kept = collections.Counter(bytes(r["digest"]) for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_colliding_digests_are_split_by_full_bytes(docs):
    got = exact_dedup.exact_groups(docs, digest=lambda t: F.substring(F.md5(t), 1, 1)).collect()
    assert sum(r["kept"] for r in got) == len({blankless(t) for _, t, *_ in ROWS})


def test_drop_copies_keeps_columns(docs, nothing):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns and out.count() == len({blankless(t) for _, t, *_ in ROWS})
    assert exact_dedup.drop_copies(nothing).count() == 0
    assert exact_dedup.exact_groups(nothing).count() == 0


# line dedup


def lines_by_hand(rows, size=3):
    seen, gone = set(), collections.defaultdict(set)
    for n, (_, t, *_) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0])):
        lines = (t or "").split("\n")
        for i in range(len(lines) - size + 1):
            w = "\n".join(lines[i : i + size])
            if re.search(r"\S", w):
                gone[n].update(range(i, i + size) if w in seen else ())
                seen.add(w)
    return [(r[0], len((r[1] or "").split("\n")), len(gone[n]), "\n".join(x for i, x in enumerate((r[1] or "").split("\n")) if i not in gone[n])) for n, r in enumerate(rows)]


def test_line_dedup(spark, docs, nothing):
    got = [tuple(r) for r in line_dedup.drop_repeated_lines(docs).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(lines_by_hand(ROWS), key=key)
    assert line_dedup.drop_repeated_lines(nothing).count() == 0
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))) for i in range(80)]
    got = [tuple(r) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(lines_by_hand(rows))


# repeated byte strings


def test_suffix_arrays():
    rng = random.Random(3)
    for alphabet in (b"ab", b"abc\xff", bytes(range(256))):
        for _ in range(40):
            t = bytes(rng.choices(alphabet, k=rng.randint(0, 200)))
            assert suffixes.suffix_array(t, 400).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    assert sorted(suffixes.suffix_array(b"a" * 900, 400).tolist()) == list(range(900))


def check_repeats(spark, rows, **options):
    size = options["size"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(df, **options).collect())
    want = collections.Counter()
    raws = [(t or "").encode() for _, t in rows]
    for (i, _), raw, spans in zip(rows, raws, suffixes.brute_force(raws, size), strict=True):
        edges = [0, *[x for s in spans for x in s], len(raw)]
        want[i, len(raw), sum(b - a for a, b in spans), len(spans), b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))] += 1
    assert got == want
    return sum(n for (_, _, gone, *_), n in want.items() if gone)


@pytest.mark.parametrize("group", [1000, 2])
def test_repeated_strings(spark, group):
    rng = random.Random(4)
    shared, rows = words(rng, 14), [(0, None), (1, ""), (2, "a" * 300), (3, words(rng, 60)), (3, words(rng, 9))]
    for i in range(4, 70):
        cut = shared[rng.randint(0, 9) :] if rng.random() < 0.8 else ""
        rows.append((i, "ab" * rng.randint(1, 60) if rng.random() < 0.1 else words(rng, rng.randint(1, 50), 500) + cut + words(rng, rng.randint(1, 30), 500)))
    assert check_repeats(spark, rows + rows[3:5], size=40, gram=8, group=group) > 20


def test_repeats_of_whole_documents(spark, docs, nothing):
    assert check_repeats(spark, [r[:2] for r in ROWS], size=400) == 1
    assert suffixes.remove_repeats(nothing).count() == 0


def test_common_passage_is_dealt_to_many_tasks(spark, monkeypatch):
    """A line that fills some documents and a passage between unlike texts give one anchor most of the pieces."""
    rng = random.Random(6)
    passage = words(rng, 6, 500)
    rows = [(i, words(rng, 12, 500) + "common line\n" * rng.randint(20, 40)) for i in range(40)]
    rows += [(100 + i, words(rng, 12, 500) + passage + words(rng, 12, 500)) for i in range(40)]
    monkeypatch.setattr(suffixes, "SHARE", 20, raising=False)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    stored, durable = [], suffixes.durable
    monkeypatch.setattr(suffixes, "durable", lambda df: stored.append(df) or durable(df))

    def largest_share(df):
        held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        return max(held) / sum(held)

    try:
        for k, v in zip(keep, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        assert check_repeats(spark, rows, size=40, gram=8, group=5) >= 40
        live = next(df for df in stored[1:] if {"lead", "anchor", "content"} <= set(df.columns))
        common = live.groupBy("anchor").count().agg(F.max("count")).first()[0]
        assert common > 0.7 * live.count()
        assert largest_share(live) < 0.7
        repeated, _ = suffixes.settle(durable(live), 5)
        assert largest_share(repeated) < 0.7
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


# toxicity and quality


def labelled(spark, make, n=600):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.3)
        rows.append((i, make(rng, y)))
        if i % 4:
            labels.append((i, y))
    rows += [(n, None), (n + 1, ""), (n + 2, "!!"), (n + 3, "word " * 60000)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, y int"), dict(labels)


def test_toxicity_finds_the_bad_words(spark):
    ship_package(spark)
    bad = ["idiot", "scumbag", "trashy", "trashed"]
    docs, labels, known = labelled(spark, lambda r, y: words(r, 40) + (" " + r.choice(bad) if y else ""))
    fitted = toxicity.fit(docs, toxicity.training_labels(labels), "y", k=5)
    got = {r["id"]: r for r in toxicity.score_toxicity(docs, fitted, k=5).collect()}
    held = [i for i in known if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i]["score"] >= 0.5) == bool(known[i]) for i in held)
    assert right / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[600]["score"] == got[601]["score"] < 0.5 and len(got) == 604
    assert all(r["evidence_ids"] for i, r in got.items() if known.get(i))
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in fitted[0].ids.tolist())


def test_toxicity_identifiers(spark):
    """Text identifiers, repeated ones, contrary labels, ties, clashing columns and empty tables."""
    ship_package(spark)
    docs, labels, known = labelled(spark, lambda r, y: words(r, 30) + (" idiot" if y else ""), 300)
    docs = docs.withColumns({"doc_id": F.concat(F.lit("d"), "doc_id"), "score": F.lit("clash"), "y": F.lit(9)})
    labels = labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    contrary = labels.filter("y = 1").withColumn("y", F.lit(0)).limit(3)
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    fitted = toxicity.fit(twice, labels.unionByName(contrary), "y", k=5)
    again = toxicity.fit(twice.repartition(7), contrary.unionByName(labels.repartition(5)), "y", k=5)
    assert fitted[0].ids.tolist() == again[0].ids.tolist() and fitted[0].labels.tolist() == again[0].labels.tolist()
    assert fitted[1:] == pytest.approx(again[1:])
    turned = {r["doc_id"] for r in contrary.collect()}
    assert {y for i, y in zip(fitted[0].ids.tolist(), fitted[0].labels.tolist(), strict=True) if i in turned} <= {0}
    got = toxicity.score_toxicity(twice, fitted, k=5).collect()
    assert len(got) == 608 and all(isinstance(i, str) for r in got for i in r["evidence_ids"])
    none = toxicity.fit(docs.limit(0), labels, "y")
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0
    assert {r["score"] < 1e-9 for r in toxicity.score_toxicity(docs, none).collect()} == {True}
    assert toxicity.score_toxicity(docs.limit(0), fitted).count() == 0


def test_toxicity_scores_equal_brute_force(spark):
    """The whole score: vocabulary counts over all rows, exact cosines, votes and calibration on the examples without themselves."""
    ship_package(spark)
    docs, labels, _ = labelled(spark, lambda r, y: words(r, 20) + (" " + r.choice(["idiot", "scumbag"]) if y else ""), 200)
    index, slope, intercept = toxicity.fit(docs, labels, "y", k=5)
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = {i: index.vocabulary.counts(t) for i, t in rows.items()}
    df = np.array([sum(t in f for f in found.values()) for t in range(len(index.idf))])
    assert np.allclose(index.idf, np.log((1 + len(rows)) / (1 + df)) + 1)

    def vector(f):
        w = np.zeros(len(index.idf))
        for t, tf in f.items():
            w[t] = (1 + math.log(tf)) * index.idf[t]
        return w / max(np.sqrt(w @ w), 1e-12)

    truth = dict(zip(index.ids.tolist(), index.labels.tolist(), strict=True))
    ids = index.ids.tolist()
    table = np.stack([vector(found[i]) for i in ids])

    def vote(f, without=None):
        cosine = np.round(table @ vector(f), 9)
        near = [n for n in np.lexsort((np.arange(len(ids)), -cosine)) if cosine[n] > 0 and ids[n] != without][:5]
        return sum(cosine[n] for n in near if truth[ids[n]]) / (sum(cosine[n] for n in near) + toxicity.PSEUDO)

    a, b = toxicity.logistic(np.array([vote(found[i], i) for i in sorted(ids)]), np.array([truth[i] for i in sorted(ids)]))
    assert (a, b) == pytest.approx((slope, intercept), rel=1e-6)
    for r in toxicity.score_toxicity(docs, (index, slope, intercept), k=5).collect():
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(a * vote(found[r["id"]]) + b))), abs=1e-9)


def test_quality_repeated_rows_and_empty_tables(spark):
    ship_package(spark)
    docs, labels, _ = labelled(spark, lambda r, y: words(r, 20) if y else "spam " * 20, 120)
    contrary = labels.filter("y = 1").withColumn("y", F.lit(0)).limit(4)
    one = quality.fit(docs.unionByName(docs), labels.unionByName(contrary), "y")
    two = quality.fit(docs.unionByName(docs).repartition(5), contrary.unionByName(labels.repartition(3)), "y")
    assert np.allclose(one, two) and np.any(one)
    assert set(quality.fit(docs.limit(0), labels, "y").tolist()) == {0.0}
    assert docs.limit(0).select(quality.scorer(spark, one)(F.col("text")).alias("s")).count() == 0


def test_block_max_search_is_exact():
    rng = random.Random(8)
    number = {f"t{i}": i for i in range(30)}
    examples = [(i, {rng.randint(0, 29): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}, rng.randint(0, 1)) for i in range(400)]
    df = np.zeros(30, np.int64)
    for _, f, _ in examples:
        df[list(f)] += 1
    index = toxicity.build(number, df, 400, examples, block=8)
    dense = np.zeros((400, 30))
    place = {int(i): n for n, i in enumerate(index.ids)}
    for i, f, _ in examples:
        for t, tf in f.items():
            dense[place[i], t] = (1 + math.log(tf)) * index.idf[t]
    dense /= np.maximum(np.sqrt(np.square(dense).sum(1, keepdims=True)), 1e-12)
    for _ in range(200):
        text = " ".join(f"t{rng.randint(0, 29)}" for _ in range(rng.randint(0, 8))).replace("t", "")
        terms = np.unique([int(x) for x in text.split()]).astype(np.int64)
        w = index.idf[terms]
        w = w / math.sqrt(float(w @ w)) if len(w) else w
        scores = np.round(dense[:, terms] @ w, 9) if len(w) else np.zeros(400)
        want = [d for d in np.lexsort((np.arange(400), -scores)) if scores[d] > 0][:10]
        got, cosines = index.nearest(terms, w, 10)
        assert got.tolist() == want and np.allclose(cosines, scores[want])


def test_quality_learns_repetition_and_marks(spark):
    ship_package(spark)
    docs, labels, known = labelled(spark, lambda r, y: words(r, 60) if y else r.choice([f"{words(r, 1)} " * 60, "|".join(words(r, 40).split())]))
    docs = docs.withColumn("score", F.lit("clash"))
    weights = quality.fit(docs, quality.training_labels(labels), "y")
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.scorer(spark, weights)(F.col("text")).alias("s")).collect()}
    held = [i for i in known if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == bool(known[i]) for i in held) / len(held) > 0.95
    assert got[600] == got[601] and got[603] < 0.5
    # no labels: nothing is known
    assert set(quality.fit(docs, labels.filter("y > 5"), "y").tolist()) == {0.0}


def test_fold_and_sample(spark):
    rows = spark.range(3000)
    got = rows.select("id", held_fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
    sample = hash_sample(rows, F.col("id"), 500)
    assert 400 < sample.count() < 600 and hash_sample(rows, F.col("id"), 3000).count() == 3000


# tokens


def odd_texts(n=3000):
    rng = random.Random(1)
    parts = ["a", "é", " ", "  ", "\n", "\n\n", "\t", "'s", "1", "!", " ", "\x1c", "\x85", "<|endoftext|>", "　", "中", "B", "\0", " the", "ing"]
    return [t or "" for _, t, *_ in ROWS] + ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(n)]


def test_ids_equal_the_library():
    path, texts = tokenizer_path(), odd_texts()
    memo, library = bpe.encoder(path), bpe.load(path)
    for _ in range(2):  # the second time from memory
        ids, counts = memo.values(texts)
        ends = np.cumsum(counts)
        for t, a, b in zip(texts, ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_token_counts(spark, docs, nothing):
    path = tokenizer_path()
    library = bpe.load(path)
    texts = odd_texts(500)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in token_count.count_tokens(df, path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert tuple(got[i])[1:] == (len(t.encode()), n, n > 512)
    assert token_count.count_tokens(docs, path).count() == len(ROWS) and token_count.count_tokens(nothing, path).count() == 0
    assert "the" in token_count.proven(path) and "<|endoftext|>" not in token_count.proven(path)


# packing


@pytest.mark.parametrize("partition_items", [20_000, 10])
def test_packing(spark, docs, nothing, partition_items):
    path, rng = tokenizer_path(), random.Random(2)
    extra = spark.createDataFrame([(100 + i, words(rng, rng.randint(0, 120), 9999)) for i in range(150)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    rows = packing.pack_documents(both, path, END_ID, 256, partition_items=partition_items).collect()
    texts = collections.Counter()
    for r in both.collect():
        ids = [*bpe.load(path).encode(r["text"] or "", add_special_tokens=False).ids, END_ID]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            texts[r["doc_id"], p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == texts
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    least = -(-sum(r["length"] for r in rows) // 256)
    assert len(seqs) <= (1.02 if partition_items > 1000 else 1.1) * least + 1
    assert packing.pack_documents(nothing, path, END_ID).count() == 0


def test_items_that_never_meet_end_the_rounds(spark):
    items = spark.createDataFrame([(i, 600 if i % 2 else 500) for i in range(400)], "item long, length long")
    seqs = packing.pack(items, 1024, partition_items=16).groupBy("seq").agg(F.count("*").alias("n")).count()
    assert 300 <= seqs <= 320


def test_rounds_that_save_little_go_on(spark):
    """The item of 412 keeps all bins open for a round that saves next to nothing; only later rounds let 507 to 511 meet."""
    lengths = [513 + i % 100 for i in range(600)] + [507 + i % 5 for i in range(40)] + [412]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    assert packing.pack(items, 1024, partition_items=12).select("seq").distinct().count() <= 612


# near copies


def naive_fingerprint(text, words_=3):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[i : i + words_]), 42) for i in range(max(1, len(w) - words_ + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(6)
    for t in [None, "", " \n", "One", "A b", "É b C d", "x " * 40, *[words(rng, rng.randint(1, 60)) for _ in range(40)]]:
        assert simhash.fingerprint(t, 3) == naive_fingerprint(t)


def pairs_by_hand(values, radius):
    return {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius}


def roots_by_hand(values, pairs):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {v: find(v) for v in values}


@pytest.mark.parametrize(("radius", "bucket"), [(0, 64), (2, 64), (2, 3), (4, 64)])
def test_links_are_complete(spark, radius, bucket):
    ship_package(spark)
    rng, values = random.Random(9), set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = simhash.links(df, radius, bucket)
    roots = {r["node"]: r["root"] for r in components.components(got).collect()}
    assert {v: roots.get(v, v) for v in values} == roots_by_hand(values, pairs_by_hand(values, radius))
    assert {(r["a"], r["b"]) for r in got.collect()} <= pairs_by_hand(values, radius)


def test_thresholds_obey_the_pigeonhole():
    rng = np.random.default_rng(1)
    bits = rng.random((500, 64)) < rng.random(64)
    both = (bits.T.astype(float) @ bits.astype(float))
    for n in (10, 500, 10**7, 10**10):
        for radius in (0, 2, 4):
            chosen = simhash.plan(n, both * n / 500, radius)
            every = simhash.partition_bits(n, both * n / 500, 3)
            assert sorted(b for p in every for b in p) == list(range(64))
            assert sum(t + 1 for _, t in chosen) == radius + 1


def test_chains_of_links(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_near_groups(spark, docs, nothing):
    ship_package(spark)
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(ROWS)
    by = collections.defaultdict(list)
    for r in got:
        by[r["component_id"]].append(r)
    assert all(sum(r["kept"] for r in g) == 1 for g in by.values())
    assert {r["id"] for r in by[4]} >= {4, 5, 6, 11}
    assert simhash.near_groups(nothing).count() == 0


def shingle_set(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_copies(spark, docs, nothing):
    """Every pair of 0.8 or more is in one group, and every group hangs together by such pairs."""
    ship_package(spark)
    rng, rows = random.Random(21), []
    for _ in range(60):
        base = words(rng, rng.choice([3, 30, 120, 400]), 5000).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy), "en", "s"))
    rows += [(1000, None, "en", "s"), (1001, " ", "en", "s"), (None, rows[0][1], "en", "s"), (0, rows[0][1].upper(), "en", "s")]
    df = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)
    got = near_copies.near_copy_groups(df).collect()
    assert len(got) == len(rows)
    sets = {i: shingle_set(t) for i, t, *_ in rows if i is not None}
    close = {(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)}
    wanted = roots_by_hand(sorted(sets), close)
    assert len(close) > 30
    assert {r["id"]: r["component_id"] for r in got if r["id"] is not None} == wanted
    assert next(r for r in got if r["id"] is None)["component_id"] == wanted[0]
    assert sorted(r["id"] for r in got if r["kept"]) == sorted(set(wanted.values()))
    assert near_copies.drop_near_copies(docs).columns == docs.columns
    assert near_copies.drop_near_copies(nothing).count() == 0


def test_a_large_group_gives_few_candidates(spark, monkeypatch):
    """Three hundred copies with a change each, and as many unlike texts around a long common passage."""
    ship_package(spark)
    rng = random.Random(22)
    base, passage = words(rng, 200, 9000).split(), words(rng, 150, 9000)
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(200)] = f"y{i}"
        rows.append((i, " ".join(copy), "en", "s", *CLASH))
        rows.append((1000 + i, f"{passage} {words(rng, 60, 10**6)}", "en", "s", *CLASH))
    df = spark.createDataFrame(rows, SCHEMA)
    compared = []
    similar = near_copies.similar_pairs
    monkeypatch.setattr(near_copies, "similar_pairs", lambda sets, pairs, *a: compared.append(pairs.count()) or similar(sets, pairs, *a))
    got = {r["id"]: r["component_id"] for r in near_copies.near_copy_groups(df).collect()}
    assert {got[i] for i in range(300)} == {0} and all(got[1000 + i] == 1000 + i for i in range(300))
    assert sum(compared) < len(rows) * 12


def test_the_order_of_shingles_changes_nothing(spark):
    """Every pair of the similarity shares a posting that the bound lets pass, whatever counts the order comes from."""
    rng = random.Random(23)
    base = words(rng, 90, 5000).split()
    texts = []
    for _ in range(40):
        copy = base[: rng.randint(70, 90)]
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"q{rng.randint(0, 999)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    sets = {near_copies.set_mark(np.unique(simhash.shingle_hashes(t, 5))): shingle_set(t) for t in texts}
    for seed in range(3):
        levels = np.random.default_rng(seed).integers(0, 3, 1 << near_copies.CELL_BITS).astype(np.uint8)
        met = near_copies.shared_postings(df, 5, 0.8, levels)
        left = met.withColumns({"root": F.col("bag"), "top": F.lit(0).cast("long"), "c": F.lit(2500)})
        earlier = Window.partitionBy("bag").orderBy("pos", "key").rowsBetween(Window.unboundedPreceding, -1)
        left = left.withColumn("earlier", F.collect_list("key").over(earlier))
        found = {(r["a"], r["b"]) for r in near_copies.pairs_across(left, 0.8).collect()}
        close = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
        assert close and close <= found


def test_hubs_that_are_outsiders(spark):
    """Two texts of over 0.8 among texts like both, of which some have lesser and some greater hashes: no hub is one of the two."""
    ship_package(spark)
    from xxhash import xxh64_intdigest

    rng = random.Random(25)
    base = words(rng, 200, 9000).split()

    def changed(places):
        copy = list(base)
        for p in places:
            copy[p] = f"z{rng.randint(0, 10**9)}"
        return " ".join(copy)

    def mark(t):
        return int(np.array([xxh64_intdigest(np.unique(simhash.shingle_hashes(t, 5)).tobytes(), 42)], np.uint64).view(np.int64)[0])

    two = [changed([20, 70]), changed([120, 170])]
    others = [changed(rng.sample(range(5, 195), 6)) for _ in range(500)]
    low, high = sorted(map(mark, two))
    assert sum(mark(t) < low for t in others) > 50 and sum(mark(t) > high for t in others) > 50
    sets = list(map(shingle_set, [*two, *others]))
    close = {(a, b) for a in range(502) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert (1, 0) in close
    rows = [(i, t, "en", "s", *CLASH) for i, t in enumerate([*two, *others])]
    got = {r["id"]: r["component_id"] for r in near_copies.near_copy_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == roots_by_hand(range(502), {(b, a) for a, b in close})


# search


def test_top_k(spark):
    ship_package(spark)
    rng = np.random.default_rng(3)
    kind = StructType().add("vec_id", LongType()).add("embedding", ArrayType(DoubleType())).add("score", StringType())
    rows = [(i, rng.normal(size=24).tolist(), "c") for i in range(120)] + [(i, [0.5] * 24, "c") for i in range(120, 140)]
    rows += [(140, None, "c"), (160, [None] * 24, "c"), (180, [float("nan")] * 24, "c"), (200, [float("inf")] * 24, "c"), (220, [1.0], "c"), (240, [], "c"), (None, [1.0] * 24, "c"), (20, [2.0] * 24, "c")]
    vectors = spark.createDataFrame(rows, kind)
    live = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in live:
        if i % 20 == 0:
            asked.setdefault(i, []).append(v)
    got = collections.defaultdict(list)
    for r in topk.neighbours(vectors, k=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(asked)
    for q, queries in asked.items():
        answers = []
        for v in queries:
            scores = [(-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in live if i != q]
            answers.append([(n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:7])])
        assert got[q] in answers
    assert topk.neighbours(vectors.limit(0)).count() == 0


def test_a_repeated_query_is_its_least_vector(spark):
    rows = [(20, [3.0, 0.0]), (20, [1.0, 2.0]), (20, [1.0, -2.0]), (20, [2.0, 9.0]), (1, [1.0, 1.0])]
    for turned in (rows, rows[::-1], [rows[1], rows[4], rows[0], rows[3], rows[2]]):
        got = topk.neighbours(spark.createDataFrame(turned, "vec_id long, embedding array<double>").coalesce(1), k=3).collect()
        assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(20, 1, 64 * 64 - 128 * 64)]


def test_top_k_blocks_and_large_numbers(spark):
    rows = [(i, [int((-1) ** (i * j) * (10**15 + i * j)) for j in range(3)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    small = df.select("vec_id", F.transform("v", lambda x: x % 1000).alias("v"))
    for data in (small, df.select("vec_id", F.transform("v", lambda x: (x / 10**7).cast("long")).alias("v"))):
        local = [(r["vec_id"], r["v"]) for r in data.collect()]
        got = topk.top_k(data.select(F.col("vec_id").alias("query_id"), "v"), data, 4, query_block=7, candidate_block=5).collect()
        for q, v in local:
            want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in local if i != q)[:4]
            assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


# mixing


def test_exponent():
    tokens = [900, 50, 50]
    a = mixing.exponent_for(tokens, 0.8, None, 1000)
    assert 0 < a < 1 and mixing.entropy(mixing.tempered(tokens, a)) == pytest.approx(0.8 * math.log(3))
    assert mixing.exponent_for([10, 10], 1.0, None, 20) == 1.0
    assert mixing.exponent_for(tokens, 0.1, None, 1000) == 1.0
    limited = mixing.exponent_for(tokens, None, 2.0, 1000)
    assert max(w * 1000 / n for w, n in zip(mixing.tempered(tokens, limited), tokens, strict=True)) == pytest.approx(2.0)
    assert mixing.exponent_for(tokens, None, 100.0, 1000) == 0.0
    assert mixing.plan_quotas([0, 0]) == [0, 0]


def test_quotas_by_hand():
    # weights 3 : 1 at exponent 1/2
    tokens = [900, 100]
    target = mixing.entropy([3, 1]) / math.log(2)
    assert mixing.exponent_for(tokens, target, None, 1000) == pytest.approx(0.5)
    assert mixing.plan_quotas(tokens, target, None, 1000) == [750, 250]
    # the small source may give 150, and the rest goes to the other
    assert mixing.plan_quotas(tokens, 1.0, 1.5, 1000) == [850, 150]
    assert mixing.plan_quotas(tokens, 1.0, 1.0, 800) == [700, 100]
    assert mixing.plan_quotas(tokens, 1.0, 1.0, 5000) == [900, 100]
    # two sources held at their limits, one after the other
    assert mixing.plan_quotas([800, 100, 100], 1.0, 2.0, 900) == [500, 200, 200]
    assert mixing.plan_quotas([600, 300, 100], 1.0, 1.1, 900) == [460, 330, 110]


def test_small_sources_do_not_scale_down_the_mix():
    def kept(tokens, repeats=1.0, part=0.9, target=0.99):
        quotas = mixing.plan_quotas(tokens, target, repeats, int(part * sum(tokens)))
        assert all(0 < q <= repeats * n for q, n in zip(quotas, tokens, strict=True))
        return quotas, sum(quotas) / sum(tokens)

    large = [2 * 10**9] + [4 * 10**9 // 19] * 19
    even, share = kept(large)
    assert share == pytest.approx(0.9, rel=1e-6) and even[0] / sum(even) < 0.3
    more, share_more = kept([*large, 10])
    assert more[-1] <= 10 and share_more == pytest.approx(0.9, rel=1e-6)
    assert max(abs(a - b) / b for a, b in zip(more, even)) < 0.01
    assert kept([10**9 // i for i in range(1, 1001)])[1] == pytest.approx(0.9, rel=1e-6)
    # a little more in a small source changes little
    one, two = kept([6 * 10**9, 30_000_000])[0], kept([6 * 10**9, 30_300_000])[0]
    assert abs(one[0] - two[0]) / one[0] < 0.01 and abs(one[1] - two[1]) / one[1] < 0.02
    assert kept(large, 2.0, 1.5)[1] == pytest.approx(1.5, rel=1e-6)


def drawn_by_hand(rows, quotas, blocks, seed="mix"):
    """Rows as (source, epoch, id), read off the definition."""
    out = collections.Counter()
    for s, quota in quotas.items():
        own = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, src in rows if src == s]
        total = sum(n for _, n in own)
        for epoch in range(-(-quota // total) if total else 0):
            left, keyed = min(quota - epoch * total, total), []
            for i, n in own:
                key = hashlib.md5(f"{seed}|{epoch}|{'' if i is None else i}".encode()).hexdigest()
                keyed.append((int(key[:8], 16) * blocks // (1 << 32), key, i, n))
            ahead = 0
            for _, _, i, n in sorted(keyed, key=lambda k: k[:2]):
                if ahead < left:
                    out[s, epoch, i] += 1
                ahead += n
    return out


def test_mixing(spark, docs, nothing, monkeypatch):
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randint(0, 30)), "en", rng.choice(["big"] * 6 + ["small", "tiny", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 400)
    totals = collections.Counter()
    for _, t, _, s in rows:
        totals[s] += len(t.split())
    names = sorted(totals, key=lambda s: (s is not None, s or ""))
    for repeats in (1.0, 2.5):
        quotas = dict(zip(names, mixing.plan_quotas([totals[s] for s in names], 0.9, repeats), strict=True))
        got = collections.Counter((r["source"], r["epoch"], r["id"]) for r in mixing.mix(df, 0.9, repeats).collect())
        assert got == drawn_by_hand(rows, quotas, 1)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 10)
    out = mixing.mix(df, 0.9, 1.0).groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    quotas = dict(zip(names, mixing.plan_quotas([totals[s] for s in names], 0.9, 1.0), strict=True))
    assert all(0 <= r["t"] - quotas[r["source"]] < 31 for r in out)
    assert mixing.draw(docs).columns == docs.columns and mixing.draw(nothing).count() == 0


def test_mixing_counts_tokens_of_the_tokenizer(spark, tmp_path):
    from oscilla.llm.queries import PLANS

    ship_package(spark)
    path, rows = tokenizer_path(), [(1, "中文没有空格" * 30, "en", "zh"), (2, "a=b;c(d)" * 40, "en", None), (3, "some words here", "en", "s"), (4, None, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {i: len(bpe.load(path).encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows}
    got = {r["id"]: r["tokens"] for r in mixing.mix(df, None, 1.0, tokenizer=path).collect()}
    assert want[1] > 30 and got == {i: want[i] for i in got} and {1, 2, 3} <= set(got)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert all(r["tokens"] == want[r["doc_id"]] for r in PLANS["op10_source_mixing"](spark, str(tmp_path)).collect())
