"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

The statistics are computed inside Spark tasks. Training takes a bounded sample of labelled rows; every document is scored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorite.llm import gbt
from fluorite.llm.common import fold, map_batches

#: Labelled rows that a classifier is fitted on at most, those with the smallest hash of doc_id.
MAX_TRAINING_ROWS = 20_000

#: The most frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for was on are as with be by at from this or an "
    "die der und das den von zu ist im nicht sich mit auf für ein eine des auch "
    "de la le et les des un une du en que est dans pour qui par sur au pas avec "
    "el los las y que una por con para se del no su al lo es".split()
)
#: Characters whose share of the text counts as one statistic each, or together.
MARKS = ["!", "?", ".", ",", "|", "#", "*", "%", "$", "&", "=", "<", "\"", "'", ":", ";", "-", "@", "/"]

NAMES = [
    "log_bytes", "upper", "lower", "digit", "space", "newline", "other_ascii", "wide", "entropy", *[f"mark_{m}" for m in MARKS],
    "log_words", "word_length", "long_words", "distinct_words", "top_word", "top5_words", "repeats", "function_words",
    "caps_words", "marked_words", "single_words", "line_words", "repeated_lines", "line_ends",
]


def statistics(text: str | None) -> list[float]:
    """The features of one text; a null counts as empty, an empty text has zeros."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = h[h > 0] / n
    upper, lower, digit = int(h[65:91].sum()), int(h[97:123].sum()), int(h[48:58].sum())
    other = int(h[33:127].sum()) - upper - lower - digit
    out = [np.log1p(len(raw)), upper / n, lower / n, digit / n, h[32] / n, h[10] / n, other / n, int(h[128:].sum()) / n, float(-(share * np.log2(share)).sum())]
    out += [h[ord(m)] / n for m in MARKS]
    words = raw.split()
    k = max(1, len(words))
    seen = Counter(words)
    top = [c for _, c in seen.most_common(5)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    low = Counter({w: c for w, c in seen.items() if w.isalpha() and len(w) < 6})
    out += [
        np.log1p(len(words)),
        lengths.sum() / k,
        float((lengths > 14).sum()) / k,
        len(seen) / k,
        (top[0] if top else 0) / k,
        sum(top) / k,
        sum(map(bytes.__eq__, words, words[1:])) / k,
        sum(c for w, c in low.items() if w.decode().lower() in FUNCTION_WORDS) / k,
        sum(c for w, c in seen.items() if len(w) > 1 and w.isupper()) / k,
        sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,") / k,
        float((lengths == 1).sum()) / k,
        np.log1p(k / m),
        1 - len(set(lines)) / m,
        sum(x.rstrip()[-1:] in b".!?:" for x in lines) / m,
    ]
    return [float(v) for v in out]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int], max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, text and y of at most ``max_rows`` labelled documents outside the held-out fold.

    A document labelled twice takes the larger label; null ids and labels don't count; of rows with the same doc_id the
    smallest text counts, so the bound is one of rows too.
    """
    n, held = held_out
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), n) != held))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # the bound makes it safe to broadcast
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def collect_features(rows: DataFrame, describe, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and ids of a bounded table of training rows, in order of id."""

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            x = [describe(t) for t in b.column("text").to_pylist()]
            return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "y": b.column("y"), "x": pa.array(x, pa.list_(pa.float64()))})

        return one

    got = map_batches(rows.select("doc_id", "text", "y"), "doc_id long, y int, x array<double>", make).toArrow()
    ids, y = got["doc_id"].to_numpy(), got["y"].to_numpy()
    x = np.asarray(got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), width) if len(ids) else np.zeros((0, width))
    order = np.lexsort((x.sum(1), ids))
    return x[order], y[order], ids[order]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = (5, 0), max_rows: int = MAX_TRAINING_ROWS) -> gbt.Trees:
    x, y, _ = collect_features(training_rows(docs, labels, label, held_out, max_rows), statistics, len(NAMES))
    return gbt.fit(x, y)


def score(docs: DataFrame, model: gbt.Trees, into: str = "quality_score") -> DataFrame:
    """``docs`` with ``into`` (0 to 1). Other columns stay; a column of that name is replaced.

    A null text scores like an empty one, which has zeros for statistics; a whole text of any length is read; equal texts
    score alike, each row by itself; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c != into]
    schema = docs.select(*names).schema.add(into, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(NAMES))
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(gbt.sigmoid(shared.value.margin(x)))], names=[*b.schema.names, into])

        return one

    return map_batches(docs.select(*names), schema, make)
