"""Toxicity classifier: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of lexicon words, how near they stand to words of the second person, capitals, punctuation, and how
many words are written to hide their letters. The lexicon is a short fixed list and what the training rows teach: words
and word beginnings that occur in toxic documents almost alone.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorite.llm import gbt
from fluorite.llm.common import map_batches, stage
from fluorite.llm.quality import MAX_TRAINING_ROWS, collect_features, training_rows

#: Insults that count before anything is learned.
SEED_LEXICON = frozenset(
    "idiot idiots stupid moron morons loser losers scum trash garbage worthless pathetic disgusting clown imbecile dumb "
    "fool filth vermin bastard bitch asshole shit fuck fucking cunt retard kill die hate "
    "dumm idioten blöd arschloch scheiße abschaum wertlos ekelhaft versager müll "
    "stupide imbécile connard salope merde ordure minable dégoûtant raté crétin "
    "estúpido imbécil basura escoria inútil asqueroso patético perdedor payaso mierda".split()
)
#: Words of the second person.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deinen ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros vuestro os".split())
#: Characters that stand for letters.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

MAX_LEXICON = 4000
#: Parts of the training rows for the calibration.
FOLDS = 3
#: Beginnings of words that count as units besides whole words.
STEMS = (4, 5, 6)

WORD = re.compile(r"[^\W\d_]+")
# It begins where a run of letters does and gives nothing back, so a long run without a mark is read once.
HIDDEN = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$!*]++[^\W\d_][\w@$!*]*+")
SPELLED = re.compile(r"\b(?:[^\W\d_][ .*_-]){3,}[^\W\d_]\b")

NAMES = [
    "hits", "hit_share", "weight_share", "weight_max", "distinct_hits", "seed_share", "stem_share", "stem_hits", "you_share", "near_you",
    "upper", "caps_words", "exclaim", "question", "punctuation", "stars", "hidden", "hidden_hits", "spelled", "log_words", "word_length",
]


def units(text: str | None) -> set[str]:
    """What a lexicon entry can be: a text's words, and beginnings of words with a dash."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:k] + "-" for w in words for k in STEMS if len(w) > k}


def unit_counts(rows: DataFrame) -> DataFrame:
    """unit, t0, n0, t1, n1, ...: how many toxic documents, and how many in all, hold a unit in each fold of ``rows`` (text, y, fold)."""

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            got = [units(t) for t in b.column("text").to_pylist()]
            sizes = [len(s) for s in got]
            flat = [u for s in got for u in s]
            return pa.RecordBatch.from_pydict({"unit": pa.array(flat, pa.string()), **{c: pa.array(np.repeat(b.column(c).to_numpy(), sizes), pa.int32()) for c in ("y", "fold")}})

        return one

    sums = [x for f in range(FOLDS) for x in (F.sum(F.when(F.col("fold") == f, F.col("y")).otherwise(0)).alias(f"t{f}"), F.count_if(F.col("fold") == f).alias(f"n{f}"))]
    return map_batches(rows.select("text", "y", "fold"), "unit string, y int, fold int", make).groupBy("unit").agg(*sums)


def lexicon(counts: DataFrame, without: int | None = None, size: int = MAX_LEXICON, min_docs: int = 6, min_share: float = 0.7) -> dict[str, float]:
    """Entries with at least ``min_docs`` documents of which ``min_share`` are toxic, by log-odds; at most ``size``.

    ``counts``: of ``unit_counts``; the documents of fold ``without`` don't count.
    """
    t, n = (sum((F.col(f"{c}{f}") for f in range(FOLDS) if f != without), F.lit(0)) for c in "tn")
    counts = counts.select("unit", t.alias("t"), n.alias("n"))
    odds = F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5))
    best = counts.where((F.col("n") >= min_docs) & (F.col("t") >= min_share * F.col("n"))).select("unit", odds.alias("w"))
    return {r.unit: r.w for r in best.orderBy(F.col("w").desc(), "unit").limit(size).collect()}


class _Weights(dict):
    """Weights of the words a worker has met, for at most so many words at a time."""

    def __init__(self, weigh, size: int = 300_000):
        super().__init__()
        self.weigh, self.size = weigh, size

    def __missing__(self, word: str) -> float:
        if len(self) >= self.size:
            self.clear()
        w = self[word] = self.weigh(word)
        return w


class Features:
    def __init__(self, lexicon: dict[str, float]):
        self.words = {w: 2.0 for w in SEED_LEXICON} | {w: v for w, v in lexicon.items() if w[-1] != "-"}
        self.stems = {k: {w[:-1]: v for w, v in lexicon.items() if w[-1] == "-" and len(w) == k + 1} for k in STEMS}

        self.met = _Weights(self.weight)

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.met = _Weights(self.weight)

    def weight(self, word: str) -> float:
        return max(self.words.get(word, 0.0), *(self.stems[k].get(word[:k], 0.0) if len(word) > k else 0.0 for k in STEMS))

    def __call__(self, text: str | None) -> list[float]:
        """The features of one text; a null counts as empty, an empty text has zeros."""
        text = text or ""
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        low = text.lower()
        words = WORD.findall(low)
        n, chars = max(1, len(words)), max(1, int(raw.sum()))
        weights = list(map(self.met.__getitem__, words))
        total = sum(weights)
        at = [k for k, v in enumerate(weights) if v > 0] if total else []
        known = {words[k] for k in at}
        addressed = sum(map(SECOND_PERSON.__contains__, words))
        near = 0.0
        if at and addressed:
            you = np.array([k for k, w in enumerate(words) if w in SECOND_PERSON])
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - at), np.abs(you[np.maximum(k - 1, 0)] - at))
            near = float(np.mean(1 / (1 + gap)))
        hidden = HIDDEN.findall(low) if raw[48:58].any() or raw[[33, 36, 42, 64]].any() else []
        hidden_hits = sum(self.weight(re.sub(r"[^\w]|_", "", h.translate(DISGUISES))) > 0 or self.weight(re.sub(r"[\W\d_]", "", h)) > 0 for h in hidden)
        spelled = SPELLED.findall(low)
        spelled_hits = sum(self.weight(re.sub(r"[\W\d_]", "", s)) > 0 for s in spelled)
        upper = int(raw[65:91].sum())
        seed = sum(words[k] in SEED_LEXICON for k in at)
        on_stem = sum(words[k] not in self.words for k in at)
        hits = len(at) + hidden_hits + spelled_hits
        caps = sum(map(str.isupper, WORD.findall(text))) if upper > 0.1 * chars else 0
        return [
            float(hits), hits / n, total / n, max(weights, default=0.0), float(len(known)), seed / n, on_stem / n, float(on_stem), addressed / n, near,
            upper / chars, caps / n, raw[33] / chars, raw[63] / chars, int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) / chars, raw[42] / chars,
            len(hidden) / n, float(hidden_hits), float(len(spelled)), float(np.log1p(len(words))), sum(map(len, words)) / n,
        ]


class Model:
    def __init__(self, features: Features, trees: gbt.Trees, calibration: gbt.Isotonic):
        self.features, self.trees, self.calibration = features, trees, calibration

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, len(NAMES))
        return self.calibration(self.trees.margin(x))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = (3, 1), max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Lexicon and trees of all training rows, calibrated on margins of rows that those who gave them haven't seen.

    For each of ``FOLDS`` parts of the training rows, a lexicon and trees are learned from the other parts and give the
    part's margins; the calibration is fitted to all of these. With one label only there is nothing to calibrate.
    """
    part = F.shiftright(F.crc32(F.col("doc_id").cast("string").cast("binary")), 8) % FOLDS
    rows = stage(training_rows(docs, labels, label, held_out, max_rows).withColumn("fold", part.cast("int")))
    counts = stage(unit_counts(rows))
    margins, truth = [], []
    for f in range(FOLDS):
        features = Features(lexicon(counts, f))
        x, y, ids = collect_features(rows, features, len(NAMES))
        own = np.array([(zlib.crc32(str(i).encode()) >> 8) % FOLDS == f for i in ids.tolist()], bool)
        if not own.any() or not 0 < y[~own].sum() < (~own).sum():
            continue
        margins.append(gbt.fit(x[~own], y[~own]).margin(x[own]))
        truth.append(y[own])
    features = Features(lexicon(counts))
    x, y, _ = collect_features(rows, features, len(NAMES))
    margin, seen = np.concatenate([*margins, np.zeros(0)]), np.concatenate([*truth, np.zeros(0)])
    usable = 0 < seen.sum() < len(seen)
    return Model(features, gbt.fit(x, y), gbt.Isotonic(margin if usable else np.zeros(0), seen if usable else np.zeros(0)))


def score(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """``docs`` with ``into`` (0 to 1). Other columns stay; a column of that name is replaced.

    A null text scores like an empty one, which has zeros for features; a whole text of any length is read; equal texts score
    alike, each row by itself; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c != into]
    schema = docs.select(*names).schema.add(into, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(b.column("text").to_pylist()), pa.float64())], names=[*b.schema.names, into])

        return one

    return map_batches(docs.select(*names), schema, make)
