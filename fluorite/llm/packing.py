"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source is a queue of its documents' ids, in order of doc_id. Time runs in windows of about ``window_tokens`` ids. A
window grants each queue its target share as credit; the queue serves the whole ids its credit covers and carries the
fraction (its deficit) to the next window. So after ``w`` windows a queue of ``n`` ids, to be emptied in ``windows``
windows, has served exactly ``floor(w * n / windows)`` of them: the round-robin needs no simulation, and any task can place
any document, whatever partition holds it. Deficits carry over windows and partitions because they follow from ``w`` alone.

With target weights, queues empty at different times. The time between two of these ends is a phase with its own
windows, over the queues that are still filled. Without weights the targets are the shares of the corpus, all queues end
together and there is one phase. Windows follow each other in one stream of ids, cut every ``max_tokens``: all sequences
are full but the last.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fluorite.llm.common import stage
from fluorite.llm.tokenfile import id_width, tokenise
from fluorite.llm.tokens import default_path

#: Sources beyond so many share queues by hash, which bounds what is broadcast and what placing a piece costs; one that has a
#: weight always keeps its own.
MAX_QUEUES = 256

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


def phases(totals: dict[str, int], weights: dict[str, float] | None, window_tokens: int) -> list[dict]:
    """Phases in order: base (ids before it), windows, and for each queue from and to (its ids in this phase)."""
    totals = {q: n for q, n in sorted(totals.items()) if n}
    if not weights:
        ends = [(Fraction(1), dict(totals))]
    else:
        share = {q: Fraction(weights.get(q, 0)).limit_denominator(10**9) for q in totals}
        late = {q for q in totals if share[q] <= 0}  # no weight: after all others, by corpus share
        ends = []
        for t in sorted({totals[q] / share[q] for q in totals if q not in late}):
            ends.append((t, {q: totals[q] if q not in late and totals[q] / share[q] <= t else 0 if q in late else int(t * share[q]) for q in totals}))
        if late:
            ends.append((None, dict(totals)))
    out, done, base = [], dict.fromkeys(totals, 0), 0
    for _, to in ends:
        n = sum(to[q] - done[q] for q in to)
        if n:
            out.append({"base": base, "windows": max(1, round(n / window_tokens)), "queues": {q: (done[q], to[q]) for q in to if to[q] > done[q]}})
            base, done = base + n, to
    return out


class _Placer:
    """Where a run of a queue's ids lies in the stream."""

    def __init__(self, plan: list[dict]):
        self.plan = []
        for p in plan:
            n = np.array([hi - lo for lo, hi in p["queues"].values()], np.int64)
            # floor(w * n / windows) by quotient and remainder: the products stay small for up to 2**31 windows.
            self.plan.append((p["base"], p["windows"], n // p["windows"], n % p["windows"], {q: (k, *span) for k, (q, span) in enumerate(p["queues"].items())}))
        self.last: tuple | None = None

    def _window(self, phase: int, w: int, k: int) -> int:
        """Where queue ``k``'s ids of window ``w`` begin; runs come in order, so mostly the last one is asked again."""
        if self.last is None or self.last[0] != (phase, w, k):
            base, windows, whole, rest, _ = self.plan[phase]
            before, after = w * whole + w * rest // windows, (w + 1) * whole + (w + 1) * rest // windows
            self.last = ((phase, w, k), base + int(before.sum()) + int((after[:k] - before[:k]).sum()))
        return self.last[1]

    def runs(self, queue: str, first: int, n: int):
        """(ids before it in the run, ids, place in the stream) for each piece of ids ``first`` to ``first + n``."""
        for phase, (_, windows, _, _, queues) in enumerate(self.plan):
            if queue not in queues:
                continue
            k, lo, hi = queues[queue]
            at, end, own = max(first, lo) - lo, min(first + n, hi) - lo, hi - lo
            while at < end:
                # the window that serves id `at`: the largest w with floor(w * own / windows) <= at
                w = ((at + 1) * windows - 1) // own
                stop = min(end, (w + 1) * own // windows)
                yield at + lo - first, stop - at, self._window(phase, w, k) + at - w * own // windows
                at = stop


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, max_tokens: int = 1024, window_tokens: int = 65_536, source: str = "source", weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and ids (little-endian u32).

    ``docs``: doc_id, text and ``source``. A null text has the end id only; a null source is a queue of its own; repeated
    rows are packed as often as they come. Pieces of a sequence lie gapless from offset 0; a document is cut where a window
    or a sequence ends. An empty table gives no rows.
    """
    path = path or default_path()
    spark, width = docs.sparkSession, id_width(path)
    named = docs.select(F.col("doc_id"), F.col("text"), F.coalesce(F.col(source).cast("string"), F.lit("\x00null")).alias("source"))
    ids = tokenise(named, path, end_id, keep="source")
    ids = stage(ids.withColumn("queue", F.col("source")))
    if ids.select("queue").distinct().limit(MAX_QUEUES + 1).count() > MAX_QUEUES:
        shared_queue = F.concat(F.lit("\x00#"), F.pmod(F.xxhash64("source"), F.lit(MAX_QUEUES)).cast("string"))
        own = [q for q, w in (weights or {}).items() if w > 0]
        ids = ids.withColumn("queue", F.when(F.col("source").isin(own), F.col("source")).otherwise(shared_queue) if own else shared_queue)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["queue", F.col("doc_id").asc_nulls_first()]
    # The ranges go by queue and document only: their bounds are sampled, and ids would go to the driver with the samples.
    dealt = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")

    def number(batches):
        served: dict[str, int] = {}
        for b in batches:
            before = []
            for q, n in zip(b.column("queue").to_pylist(), b.column("n").to_pylist(), strict=True):
                before.append(served.get(q, 0))
                served[q] = before[-1] + n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int64())], names=[*b.schema.names, "before"])

    numbered = stage(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(number, "doc_id long, n long, ids binary, source string, queue string, part int, before long"))
    # Ranges: a part holds a few neighbouring queues, so this has at most parts + MAX_QUEUES rows.
    sums = numbered.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    runs = sums.select("queue", "part", F.sum("n").over(W.partitionBy("queue").orderBy("part")).alias("upto"), "n").collect()
    base = {(r.queue, r.part): r.upto - r.n for r in runs}
    totals: dict[str, int] = {}
    for r in runs:
        totals[r.queue] = max(totals.get(r.queue, 0), r.upto)
    plan = phases(totals, weights, window_tokens)
    shared = spark.sparkContext.broadcast((plan, base))

    def place(batches):
        plan, base = shared.value
        placer = _Placer(plan)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids")}
            cols = (b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "source", "queue", "part", "before"))
            for doc, n, blob, src, q, part, before in zip(*cols, strict=True):
                raw = np.frombuffer(blob, f"<u{width}").astype("<u4").tobytes()
                for at, size, stream in placer.runs(q, base[q, part] + before, n):
                    while size:
                        seq, off = divmod(stream, max_tokens)
                        k = min(size, max_tokens - off)
                        own = raw[4 * at : 4 * (at + k)]
                        for c, v in zip(out.values(), (doc, at, k, zlib.crc32(own), n, seq, off, None if src == "\x00null" else src, own), strict=True):
                            c.append(v)
                        at, size, stream = at + k, size - k, stream + k
            kinds = {"source": pa.string(), "ids": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return numbered.mapInArrow(place, PIECES)
