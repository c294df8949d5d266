"""Lexical ranking of all documents for many items at once, with the items' common parts computed once.

Items are sets of terms, and an item's score is a sum over its terms, so a set of terms that several items hold can be summed
once for each document and shared. The sets are mined like a grammar: each item is a sequence of its terms, those of most items first;
the pairs of neighbours that occur in several items become nodes, over and over, until no pair repeats. The nodes form a DAG
whose leaves are terms: a node's accumulator is the sum of its two children's, and an item's that of the few nodes that are
left of it.

First each document is cut into terms once and its counts of the items' terms are written, which gives the statistics of
all documents; then tasks take these rows in blocks, make the accumulators of all nodes, level by level, for a block's
documents, add them up for each item, and keep each item's best. A task gives at most ``top`` rows for each item; the best of
these are the result. Items go in groups of bounded size, each of which is one pass.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fluorite.llm.common import stage

#: Terms of the items that are ranked in one pass, so what is broadcast has a bound: about 100 bytes each. An item isn't split.
GROUP_TERMS = 200_000
#: Cells of a block: (terms + nodes + items) x documents, 8 bytes each.
BLOCK_CELLS = 4_000_000
#: Bytes of a text that are cut into terms together.
PIECE = 4_000_000

# What separates terms: ASCII but letters and digits.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def term_counts(text: str | None, codes: dict[bytes, int] | None = None) -> tuple[int, Counter]:
    """How many terms a text has, and how often it has each one (those in ``codes``, by code)."""
    data, n, found, at = (text or "").encode("utf-8", "surrogatepass").translate(TERMS), 0, Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        terms = data[at:end].split()
        n += len(terms)
        found.update(terms if codes is None else map(codes.get, terms))
        at = end
    found.pop(None, None)
    return n, found


class SharedPlan:
    """Nodes for term sets that items share. Symbols 0 .. terms - 1 are terms, the following are nodes of two symbols each."""

    def __init__(self, items: list[list[int]], terms: int):
        uses: dict[int, list[int]] = {}
        for k, own in enumerate(items):
            for t in own:
                uses.setdefault(t, []).append(k)
        # Terms of the same items stand side by side.
        order = sorted(uses, key=lambda t: (-len(uses[t]), uses[t], t))
        rank = {t: k for k, t in enumerate(order)}
        self.terms, self.pairs = terms, []
        self.rests = [sorted(own, key=rank.__getitem__) for own in items]
        while self._round():
            pass
        self.left = np.array([a for a, _ in self.pairs], np.int64)
        self.right = np.array([b for _, b in self.pairs], np.int64)
        level = np.zeros(terms + len(self.pairs), np.int64)
        for k, (a, b) in enumerate(self.pairs):
            level[terms + k] = 1 + max(level[a], level[b])
        self.levels = [np.flatnonzero(level == v) for v in range(1, int(level.max(initial=0)) + 1)]

    def _round(self) -> bool:
        """Replaces pairs that repeat, the more frequent of two that overlap; False if none does."""
        count = Counter(p for s in self.rests for p in zip(s, s[1:]))
        node: dict[tuple[int, int], int] = {}
        base, made = self.terms + len(self.pairs), []
        for s in self.rests:
            out, k = [], 0
            while k < len(s):
                pair = (s[k], s[k + 1]) if k + 1 < len(s) else None
                if pair and count[pair] > 1 and (k + 2 == len(s) or count[pair] >= count[s[k + 1], s[k + 2]]):
                    out.append(node.setdefault(pair, base + len(node)))
                    k += 2
                else:
                    out.append(s[k])
                    k += 1
            made.append(out)
        used = Counter(x for s in made for x in s if x >= base)
        kept = {x: base + k for k, x in enumerate(x for x in node.values() if used[x] > 1)}
        pairs = {x: p for p, x in node.items()}
        self.pairs += [pairs[x] for x in kept]
        self.rests = [[y for x in s for y in ([x] if x < base else [kept[x]] if x in kept else pairs[x])] for s in made]
        return bool(kept)

    def additions(self) -> int:
        """Additions for each document."""
        return len(self.pairs) + sum(max(0, len(s) - 1) for s in self.rests)

    def accumulate(self, leaves: np.ndarray) -> np.ndarray:
        """``leaves``: terms x documents. Items x documents."""
        made = np.zeros((self.terms + len(self.pairs), leaves.shape[1]), np.int64)
        made[: self.terms] = leaves
        for nodes in self.levels:
            made[nodes] = made[self.left[nodes - self.terms]] + made[self.right[nodes - self.terms]]
        return np.array([made[s].sum(0) for s in self.rests]).reshape(len(self.rests), leaves.shape[1])


class Best:
    """Each item's ``top`` documents by score, then id; a missing id comes last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.item, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.missing = np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """``scores``: items x documents."""
        least = self.least
        if scores.shape[1] > self.top:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.top, axis=1)[:, -self.top])
        new, at = np.nonzero(scores >= least[:, None])
        item, score = np.concatenate([self.item, new]), np.concatenate([self.score, scores[new, at]])
        ids, missing = np.concatenate([self.ids, ids[at]]), np.concatenate([self.missing, missing[at]])
        order = np.lexsort((ids, missing, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order, place = order[place < self.top], place[place < self.top]
        self.item, self.score, self.ids, self.missing = item[order], score[order], ids[order], missing[order]
        full = place == self.top - 1
        self.least[self.item[full]] = self.score[full]


def _counted(docs: DataFrame, codes: dict[bytes, int]) -> DataFrame:
    """doc_id, n, codes and counts of the terms in ``codes``, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        codes = shared.value
        for b in batches:
            got = [term_counts(t, codes) for t in b.column("text").to_pylist()]
            own = [[(c, k) for c, k in sorted(found.items())] for _, found in got]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"),
                "n": pa.array([n for n, _ in got], pa.int64()),
                "codes": pa.array([[c for c, _ in x] for x in own], pa.list_(pa.int32())),
                "counts": pa.array([[k for _, k in x] for x in own], pa.list_(pa.int64())),
            })

    return docs.mapInArrow(run, "doc_id long, n long, codes array<int>, counts array<long>")


def _best(counted: DataFrame, items: list[tuple[int | None, list[int]]], weights: np.ndarray, docs: int, words: int, top: int) -> DataFrame:
    """item, doc_id and score: each task's best documents for each item."""
    plan = SharedPlan([[t for t in own if weights[t] > 0] for _, own in items], len(weights))
    shared = counted.sparkSession.sparkContext.broadcast((plan, weights))
    block = max(16, BLOCK_CELLS // (len(weights) + len(plan.pairs) + len(items) + 1))

    def run(batches):
        plan, weights = shared.value
        best = Best(len(items), top)
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                n = b.column("n").to_numpy()
                if len(n) and 90 * int(n.max()) * docs < 2**63:
                    m = 10 + 90 * n * docs // words
                else:
                    m = np.array([10 + 90 * int(x) * docs // words for x in n], np.int64)
                sizes = np.diff(b.column("codes").offsets.to_numpy())
                codes, tf = b.column("codes").flatten().to_numpy(), b.column("counts").flatten().to_numpy()
                of = np.repeat(np.arange(len(n)), sizes)
                leaves = np.zeros((len(weights), len(n)), np.int64)
                leaves[codes, of] = weights[codes] * (1_000_000_000 * tf // (1000 * tf + 8 * m[of]))
                ids = b.column("doc_id")
                best.add(plan.accumulate(leaves), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_pydict({"item": pa.array(best.item, pa.int64()), "doc_id": pa.array(best.ids, pa.int64(), mask=best.missing), "score": pa.array(best.score, pa.int64())})

    return counted.mapInArrow(run, "item long, doc_id long, score long")


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id and term (binary), distinct."""

    def run(batches):
        for b in batches:
            own = [list(term_counts(t)[1]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"item_id": b.column("item_id"), "terms": pa.array(own, pa.list_(pa.binary()))})

    cut = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "item_id long, terms array<binary>")
    return cut.select("item_id", F.explode("terms").alias("term")).distinct()


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's ``top`` documents with a score above 0.

    Rows of ``items`` with one item_id are one item with the terms of all; a null item_id is one more. Repeated rows of
    ``docs`` are documents each; equal scores go by doc_id, a null one last. Null and empty texts have no terms: such documents
    don't count, such items have no rows. Texts may have any length; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    terms = stage(item_terms(items, item_id, item_text))
    groups = max(1, math.ceil(terms.count() / GROUP_TERMS))
    out: DataFrame | None = None
    for g in range(groups):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()
        codes = {t: k for k, t in enumerate(sorted({bytes(r.term) for r in own}))}
        by_item: dict[int | None, list[int]] = {}
        for r in own:
            by_item.setdefault(r.item_id, []).append(codes[bytes(r.term)])
        counted = stage(_counted(rows, codes))
        n, words = counted.agg(F.count_if(F.col("n") > 0), F.greatest(F.sum("n"), F.lit(1))).first()
        weights = np.zeros(len(codes), np.int64)
        for r in counted.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")).collect():
            weights[r.code] = math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1)))
        list_of = sorted(by_item.items(), key=lambda x: (x[0] is None, x[0] or 0))
        named = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(list_of)], "item long, item_id long")
        found = _best(counted, list_of, weights, n, words, top)
        order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        found = found.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
