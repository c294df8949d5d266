"""Exact duplicates, integer clustering and shared ranking against brute force and awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fluorite.llm import centroids, contentsort, ranked

SPACE = re.compile("[\x20\x09-\x0d]+")


def copies_by_hand(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(d)
    keep = {t: min((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return sorted(((d, keep[n := SPACE.sub(" ", t or "")], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for d, t in rows), key=repr)


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_that_span_ranges(spark, many_ranges):
    rng = random.Random(3)
    start = "the same first words of a licence that many files share, longer than the key's part of them " * 2
    texts = ["hot text", "hot\t text", start + "a", start + "b", "", None, " ", "\n", "x" * 400_000, "x" * 400_000 + "y"] + [f"own {k}" for k in range(40)]
    rows = [(k, rng.choice(texts[:2]) if k % 3 == 0 else start + str(k % 7) if k % 3 == 1 and k % 2 else rng.choice(texts)) for k in range(900)]
    rows += [(5, "hot text"), (None, "hot text"), (None, "only without id"), (None, "only without id"), (2000, texts[8]), (2001, texts[8])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1, 2, "k") for d, t in rows], "doc_id long, text string, part int, run long, keep_id string").repartition(6)
    got = contentsort.exact_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == copies_by_hand(rows)
    # One row of each text stays, one with its smallest id.
    kept = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_copies_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert contentsort.exact_duplicates(empty).count() == 0


def clusters_by_hand(rows, clusters=16, rounds=3):
    v = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(v, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [q for _, q in start[:clusters]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    for step in range(rounds + 1):
        own = [min(range(len(now)), key=lambda c: (far(q, now[c]), c)) for _, q in v]
        if step < rounds:
            for c in range(len(now)):
                of = [q for (_, q), o in zip(v, own, strict=True) if o == c]
                if of:
                    now[c] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    d = [far(q, now[o]) for (_, q), o in zip(v, own, strict=True)]
    return sorted(((i, o, x, sum(y for y, p in zip(d, own, strict=True) if p == o), sum(d), hashlib.sha256(",".join(map(str, now[o])).encode()).hexdigest()) for (i, _), o, x in zip(v, own, d, strict=True)), key=repr)


@pytest.mark.parametrize("n", [0, 5, 300])
def test_clusters(spark, n):
    rng = np.random.default_rng(n)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=64) + 3 * (k % 5)]) for k in range(n)]
    if n:
        same = rows[0][1]
        rows += [(0, same), (900, same), (None, same), (901, None), (902, same[:63]), (903, [*same[:63], None]), (904, [*same[:63], float("nan")]), (905, [*same[:63], float("inf")]), (906, [0.0] * 64), (907, [0.0] * 64)]
        rows += [(1000 + k, rows[2][1]) for k in range(n)]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<float>, cluster string, norm int")
    assert sorted((tuple(r) for r in centroids.cluster(df).collect()), key=repr) == clusters_by_hand(rows)


def test_components_that_need_more_bits_raise(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(df).collect()


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranks_by_hand(docs, items, top=10):
    cut = [(d, Counter(terms_of(t))) for d, t in docs]
    n, words = sum(bool(c) for _, c in cut), max(1, sum(sum(c.values()) for _, c in cut))
    df = Counter(t for _, c in cut for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, ts in own.items():
        found = []
        for d, c in cut:
            m = 10 + 90 * sum(c.values()) * n // words
            s = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(i, k + 1, None if gone else d, -s) for k, (s, gone, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Élan", "naïve", "ünï", "日本語", "a1b2", "Q"]
    docs = [(k, rng.choice([" ", "-", "\n", "\x7f"]).join(rng.choices(words, range(66, 0, -1), k=rng.randrange(1, 80)))) for k in range(300)]
    docs += [(1000 + k, "w1 w2 W3 zeta") for k in range(40)] + [(7, "w1"), (7, "w1"), (None, "w1 w2 w3 zeta"), (2000, None), (2001, ""), (2002, "!? \x00"), (2003, "w1 " * 60_000)]
    items = [(k, " ".join(rng.choices(words, range(66, 0, -1), k=rng.randrange(1, 30)))) for k in range(30)]
    items += [(30, None), (31, ""), (32, "unknown words"), (3, "zeta"), (None, "zeta w3"), (33, "ZETA zeta"), (34, items[4][1]), (34, items[4][1])]
    return docs, items


def frames(spark, texts):
    docs, items = texts
    return spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n int, codes string").repartition(5), spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, rank int")


def test_ranks(spark, texts, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_CELLS", 4000)
    monkeypatch.setattr(ranked, "PIECE", 1000)
    got = sorted((tuple(r) for r in ranked.rank(*frames(spark, texts)).collect()), key=repr)
    assert got == ranks_by_hand(*texts)


def test_ranks_in_several_groups(spark, texts, monkeypatch):
    monkeypatch.setattr(ranked, "GROUP_TERMS", 150)
    assert sorted((tuple(r) for r in ranked.rank(*frames(spark, texts)).collect()), key=repr) == ranks_by_hand(*texts)


def test_ranks_without_documents_or_items(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert ranked.rank(docs, none).count() == 0
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.rank(docs.limit(0), item).count() == 0
    assert ranked.rank(spark.createDataFrame([(1, " ")], "doc_id long, text string"), item).count() == 0


def test_shared_plan_sums_each_item():
    rng = random.Random(1)
    common = list(range(12))
    items = [sorted({*rng.sample(common, 8), *rng.sample(range(12, 80), rng.randrange(0, 9))}) for _ in range(60)] + [[], [5], items_same := [1, 2, 40, 41, 42], items_same[:]]
    plan = ranked.SharedPlan(items, 80)
    leaves = np.array([[rng.randrange(1000) for _ in range(7)] for _ in range(80)])
    want = np.array([leaves[own].sum(0) for own in items])
    assert (plan.accumulate(leaves) == want).all()
    plainly = sum(max(0, len(own) - 1) for own in items)
    assert plan.additions() < 0.8 * plainly and plan.rests[-1] == plan.rests[-2] and len(plan.rests[-1]) == 1
    assert len(plan.levels) > 1
