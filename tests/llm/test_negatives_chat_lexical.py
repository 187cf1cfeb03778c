"""Hard negatives, chat formatting and lexical search against brute force, and on nulls, empty and long
texts, ties, repeated rows, empty tables and further columns with clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.llm import chat, lexical, negatives
from oscilla.session import ship_package

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, row int, block int, score string"
TURNS = "conv_id long, turn int, role string, text string, loss string, segment string, valid int"
DOCS = "doc_id long, text string, id string, n string, terms int, tf string, score int, rank int"
ITEMS = "item_id long, text string, item int, term string, at int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# hard negatives


def integers(vector, scale=256):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def negatives_by_hand(rows, every, positives, count, share=(30, 90)):
    live = [(i, lab, v) for i, e, lab in rows if i is not None and lab is not None and (v := integers(e)) is not None]
    anchors = {}
    for i, lab, v in live:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, q) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(q, v)), i, other) for i, other, v in live if i != a]
        near = sorted((s, i) for s, i, other in scored if other == lab)[:positives]
        for s, p in near:
            fit = sorted((t, i) for t, i, other in scored if other != lab and share[0] * -s <= -100 * t <= share[1] * -s)[:count]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, e, lab, "x", "y", 1, 2, "z") for i, e, lab in rows], VECTORS)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **options).collect())


def vectors(rng, n, width=8, labels=3):
    return [(i, [rng.gauss(0, 1) for _ in range(width)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("width", [3, 64, 70])
def test_hard_negatives(spark, monkeypatch, width):
    rows = vectors(random.Random(width), 300, width)
    want = negatives_by_hand(rows, 10, 3, 4)
    assert want and mined(spark, rows, every=10, positives=3, negatives=4) == want
    monkeypatch.setattr(negatives, "CHUNK", 16)
    monkeypatch.setattr(negatives, "BATCH", 7)
    assert mined(spark, rows, every=10, positives=3, negatives=4, block_rows=50) == want


def test_negatives_of_odd_rows(spark):
    rng = random.Random(5)
    rows = vectors(rng, 60, 4, 2)
    rows += [(None, [1.0] * 4, 0), (70, None, 0), (71, [1.0, None, 0.0, 0.0], 0), (72, [1.0, math.nan, 0.0, 0.0], 1), (73, [1.0, math.inf, 0.0, 0.0], 1), (74, [1.0] * 4, None)]
    rows += [(75, [], 0), (76, [0.5], 1), (77, [0.5, 0.5, 0.5, 0.5, 9.0], 1)]  # none, shorter and longer
    rows += [(80, [1.0, 2.0, 0.0, 0.0], 0), (80, [1.0, 1.0, 0.0, 0.0], 1), (80, [1.0, 1.0, 0.0, 0.0], 0)]  # one anchor, three rows
    rows += [(i, [0.25, 0.25, 0.25, 0.25], i % 2) for i in (91, 92, 93, 93, 94, 94)]  # ties and repeated rows
    assert mined(spark, rows, every=10, positives=3, negatives=4) == negatives_by_hand(rows, 10, 3, 4)
    assert mined(spark, [], every=10) == []
    assert mined(spark, [(10, [1.0], 0)], every=10) == []


def test_negatives_of_large_numbers(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(1e5, 1e6) for _ in range(4)], rng.randrange(2)) for i in range(60)]
    assert mined(spark, rows, every=10, positives=3, negatives=4) == negatives_by_hand(rows, 10, 3, 4)
    held = mined(spark, [(0, [3e38], 0), (1, [3e38], 0), (2, [1e12], 1), (3, [-3e38], 1)], every=10)
    assert all(abs(x) < 2**63 for r in held for x in r)


def test_intervals_hold_the_true_product():
    rng = np.random.default_rng(3)
    rows, asked = rng.normal(size=(200, 128)) * 100, rng.normal(size=(5, 128)) * 100
    codes, aligned, rest = negatives.encode(rows)
    planes = negatives.Planes(asked)
    truth, mid, loss = asked @ rows.T, 0.0, 0.0
    widths = []
    for r in range(negatives.ROUNDS):
        mid = mid + planes.product(r, codes[:, r], slice(0, 5)) * aligned[:, r]
        loss = loss + planes.rounds[r][4][:, None] * aligned[:, r]
        slack = planes.norm[:, None] * rest[:, r] + loss + 1e-6
        assert (np.abs(truth - mid) <= slack).all()
        widths.append(slack.mean())
    assert widths == sorted(widths, reverse=True) and widths[-1] < widths[0] / 5
    assert np.allclose(planes.product(2, codes[:, 2], 3), planes.product(2, codes[:, 2], slice(0, 5))[3])


def test_few_rows_are_scored_in_integers(monkeypatch):
    """The intervals leave out most rows."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(4000, 64)) * 32).astype(np.int64)
    codes, aligned, rest = negatives.encode(v.astype(float))
    batch = pa.RecordBatch.from_pydict(
        {"id": range(4000), "label": [0] * 4000, "v": v.tolist(), "codes": [c.tobytes() for c in codes], "scales": np.concatenate([aligned, rest], axis=1).tolist()}
    )
    asked = pa.RecordBatch.from_pydict({"id": range(20), "label": [0] * 20, "v": v[:20].tolist(), "positives": pa.array([None] * 20, pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())])))})
    scored = []
    exact = negatives.integer_scores
    monkeypatch.setattr(negatives, "integer_scores", lambda rows, *a: scored.append(len(rows)) or exact(rows, *a))
    got = list(negatives.search(negatives.Block([batch], 64), asked, 64, 5, True, None))
    products = v[:20] @ v.T
    for q in range(20):
        want = sorted((-products[q, j], j) for j in range(4000) if j != q)[:5]
        assert [(-s, i) for a, *_, i, s in got if a == q] == want
    assert sum(scored) < 0.05 * 20 * 4000


# chat formatting

ODD = ["</s>", "<s>[INST] x [/INST]</s>", "<\\/s>", "<\\\\\\/s> [\\INST]", "[INST", "]", "[OUT] a [ROLE] b [TEXT] c [SYS] d [/SYS]", "a\nb\n", "", " ", "é中🙂", "\\", "[\\", "<<s>", "[[/INST]]"]


def spoken_by_hand(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        everything = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        learnt = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(everything.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], TURNS)


def test_chat_round_trip(spark):
    rng = random.Random(1)
    roles = ["system", "user", "assistant", "tool", "[INST] ", "</s>", None, ""]
    rows = [(c, t, rng.choice(roles), rng.choice([*ODD, None, "plain text"])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "no name"), (None, None, "user", "no turn"), (70, 1, "assistant", "b"), (70, 1, "assistant", "b"), (70, 1, "assistant", "a")]
    rows += [(71, 0, "user", "long </s> " * 200_000), (71, 1, "assistant", "[INST] " * 200_000)]
    rows += [(72, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(12_000)]  # more than a batch
    df = turns_frame(spark, rows)
    segments = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    want = spoken_by_hand(rows)
    assert {c: tuple(r[1:5]) for c, r in got.items()} == want
    assert got[72]["valid"] and got[72]["complete"] and not got[70]["valid"]
    lengths = dict(segments.groupBy("conv_id").agg(F.sum(F.length("text"))).collect())
    assert {c: r["formatted_chars"] for c, r in got.items()} == lengths


def test_chat_marks_are_the_only_control_strings(spark):
    template = chat.Template()
    escape = chat.Escape(template.control())
    control = re.compile("|".join(map(re.escape, template.control())))
    for a in ODD:
        for b in ODD:
            assert not control.search(escape.hide(a + b)) and escape.show(escape.hide(a + b)) == a + b
            assert escape.show(escape.hide(escape.hide(a))) == escape.hide(a)
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "</s>"), (1, 2, "assistant", "ok")]
    got = chat.format_conversations(turns_frame(spark, rows)).orderBy("segment").collect()
    assert "".join(r["text"] for r in got) == "<s>[SYS] be kind [/SYS][INST] <\\/s> [/INST][OUT] ok</s>"
    assert [r["text"] for r in got if r["loss"]] == ["ok"]


def test_chat_turn_order(spark):
    def ends(*roles):
        rows = [(1, t, r, "x") for t, r in enumerate(roles)]
        r = chat.read_back(chat.format_conversations(turns_frame(spark, rows))).first()
        return r["valid"], r["complete"]

    assert ends("user", "assistant") == (True, True)
    assert ends("system", "user") == (True, False)
    assert ends("user", "user", "assistant") == (False, False)
    assert ends("assistant") == (False, False)
    assert ends("user", "assistant", "system") == (False, False)
    assert ends("tool", "user") == (False, False)


def test_chat_of_nothing_and_other_templates(spark):
    assert chat.read_back(chat.format_conversations(turns_frame(spark, []))).collect() == []
    template = chat.Template(
        roles={"human": ("<|h|>", "<|e|>", False), "bot": ("<|b|>", "<|e|>", True)},
        other=("<|o|>", "<|t|>", "<|e|>"),
        start="",
        moves={"start": {"human": "q"}, "q": {"bot": "a"}, "a": {"human": "q"}},
        ends=("a",),
    )
    rows = [(1, 0, "human", "<|b|>hi<|e|>"), (1, 1, "bot", "<\\|e|>"), (2, 0, "tool", "<|t|>")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns_frame(spark, rows), template), template).collect()}
    want = spoken_by_hand([(c, t, {"bot": "assistant"}.get(r, r), x) for c, t, r, x in rows])
    assert got[1]["loss_sha256"] == want[1][3] and got[1]["valid"] and got[1]["complete"]
    assert got[2]["n_turns"] == 1 and got[2]["turns_sha256"] == want[2][1]
    with pytest.raises(ValueError):
        chat.Template(start="<<s>")


# lexical search


def terms_by_hand(text):
    return re.findall(lexical.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranking_by_hand(docs, items, k):
    counts = [(i, Counter(t)) for i, x in docs if (t := terms_by_hand(x))]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, x in items:
        asked[i] |= set(terms_by_hand(x))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            n = sum(c.values())
            m = 10 + (90 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **options):
    d = spark.createDataFrame([(i, x, "a", "b", 1, "c", 2, 3) for i, x in docs], DOCS)
    t = spark.createDataFrame([(i, x, 1, "y", 2) for i, x in items], ITEMS)
    return sorted((tuple(r) for r in lexical.rank_documents(d, t, **options).collect()), key=str)


WORDS = ["alpha", "Beta", "GAMMA", "éÉ", "中文", "x1", "9", "ΑΩ", "don't", "a_b", "z-z", "🙂k"]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_lexical_ranking(spark):
    rng = random.Random(2)
    docs = [(i, words(rng, rng.randint(0, 30))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, " .,;\n\t\x7f"), (None, "alpha beta"), (None, "alpha beta"), (303, "alpha " * 50_000), (304, "zeta"), (304, "zeta"), (305, "Zeta"), (306, "zeta")]
    items = [(i, words(rng, rng.randint(1, 6))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "..."), (23, "unknown"), (24, "zeta"), (25, "alpha"), (25, "zeta"), (None, "beta"), (26, words(rng, 400) + " zeta")]
    want = ranking_by_hand(docs, items, 10)
    assert ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, block_terms=10, tile=7, columns=2) == want
    assert ranked(spark, docs, items, block_items=3) == want


def test_lexical_ties_take_the_smaller_identifiers(spark):
    docs = [(i, "same text") for i in range(500, 0, -1)] + [(1000 + i, "other") for i in range(3)]
    assert ranked(spark, docs, [(1, "same")], tile=16) == ranking_by_hand(docs, [(1, "same")], 10)
    assert [r[2] for r in sorted(ranked(spark, docs, [(1, "same")]))] == list(range(1, 11))


def test_lexical_search_of_nothing(spark):
    assert ranked(spark, [], [(1, "a")]) == []
    assert ranked(spark, [(1, "a")], []) == []
    assert ranked(spark, [(1, None)], [(1, "a")]) == []


def test_terms_of_every_character():
    text = "".join(f"q{chr(c)}Z" for c in [*range(0x250), 0x2028, 0x3000, 0xA0, 0xFFFD, 0x10FFFF])
    assert [t.decode() for t in lexical.terms_of(text)] == terms_by_hand(text)


def test_slices_stay_below_the_exact_range():
    rng = np.random.default_rng(1)
    weights = rng.integers(1, 2**31, 400)
    item, term = np.nonzero(rng.random((6, 400)) < 0.5)
    parts = lexical.slices_of(item, term, weights, 64)
    dense = np.zeros((6, 400))
    for a, b, users, part in parts:
        assert b - a <= 64 and part.sum(1).max() * 10**6 < lexical.EXACT
        dense[users, a:b] = part
    want = np.zeros((6, 400))
    want[item, term] = weights[term]
    assert (dense == want).all() and [a for a, *_ in parts[1:]] == [b for _, b, *_ in parts[:-1]]
