"""Token-id files: documents' ids in document order, coded by rANS in independent blocks.

A file set is a folder that needs nothing else to be read: ``table``, one Parquet row with the format's version, its
parameters, the frequency table and the table's checksum, and ``blocks``, a Parquet row for each block. A block holds whole
documents, at least one and as many as fit ``block_tokens``; one document longer than that is a block. Row:

    part int, block int     place in document order (parts follow each other, blocks within a part too)
    before long, n_ids long ids in the part before the block, and in the block
    doc_ids, doc_lens       each document's id and count of ids, in order
    coded binary            the ids, by rANS with checkpoints (see ``rans``)
    crc32s array<long>      for each checkpoint, checksum of the ids from it to the next, as little-endian u32

A block is decoded from any checkpoint on: ``read`` takes stretch after stretch, ``read_documents`` only those that hold the
documents asked for.

Work: one pass tokenises and writes ids, one pass over these counts them, then ids (not texts) are dealt by ranges of
doc_id and coded. Only the frequency table, of the vocabulary's size, and one count for each part reach the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fluorite.llm import rans
from fluorite.llm.common import map_batches, scratch_dir, stage
from fluorite.llm.tokens import default_path, encoder

BLOCK = "part int, block int, before long, n_ids long, doc_ids array<long>, doc_lens array<long>, coded binary, crc32s array<long>"
VERSION = 1
#: A lane for so many ids of a block at least: each lane's state takes 8 bytes at each checkpoint.
LANE_IDS = 128


def tokenise(docs: DataFrame, path: str | None = None, end_id: int | None = 0, keep: str = "") -> DataFrame:
    """doc_id, n long and ids binary (little-endian, 2 bytes each where the vocabulary allows, else 4), then ``keep``.

    A null or empty text has the end id only. ``keep``: a further column to carry, such as "source".
    """
    path, tail = path or default_path(), np.array([] if end_id is None else [end_id], "<u4")
    width = id_width(path)
    cols = ["doc_id", "text", *([keep] if keep else [])]

    def make():
        encode = encoder(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            blobs, sizes = [], []
            for ids, ends in encode.batch(batch.column("text")):
                at = 0
                for end in ends.tolist():
                    own = np.append(ids[at:end], tail)
                    sizes.append(len(own))
                    blobs.append(own.astype(f"<u{width}").tobytes())
                    at = end
            out = {"doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()), "ids": pa.array(blobs, pa.binary())}
            return pa.RecordBatch.from_pydict(out | ({keep: batch.column(keep)} if keep else {}))

        return one

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.col(keep).cast("string")] if keep else []))
    return map_batches(rows.select(*cols), "doc_id long, n long, ids binary" + (f", {keep} string" if keep else ""), make)


def id_width(path: str) -> int:
    return 2 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else 4


def id_counts(ids: DataFrame, path: str) -> np.ndarray:
    """How often each id of the vocabulary occurs."""
    width, size = id_width(path), encoder(path).tokenizer.get_vocab_size()

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), f"<u{width}"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(at, pa.int32()), "c": pa.array(total[at], pa.int64())})

    out = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(count, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).toLocalIterator():
        out[r.k] = r.c
    return out


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 0, block_tokens: int = 262_144, lanes: int = 2048, checkpoint_steps: int = 64) -> str:
    """Tokenise ``docs`` and write their file set; returns its folder (None: a new one in the scratch folder).

    Documents come in ascending doc_id (nulls first; rows with the same doc_id in the order of their ids). A null or empty
    text has the end id only; texts may have any length; repeated rows are written each. Other columns are ignored,
    whatever their names; an empty table gives a file set without blocks.
    """
    spark = docs.sparkSession
    path, folder = path or default_path(), folder or scratch_dir(spark)
    width, ids = id_width(path), stage(tokenise(docs, path, end_id))
    freq = rans.Table.of_counts(id_counts(ids, path)).freq.astype("<u4").tobytes()
    meta = [(VERSION, rans.BITS, end_id, width, bytearray(freq), zlib.crc32(freq))]
    spark.createDataFrame(meta, "version int, bits int, end_id long, width int, frequencies binary, crc32 long").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq)

    def code(batches):
        part, block, before, held, size = -1, 0, 0, [], 0
        table = rans.Table(np.frombuffer(shared.value, "<u4"))

        def flush():
            own = np.frombuffer(b"".join(x[2] for x in held), f"<u{width}").astype("<u4")
            n = max(1, min(lanes, len(own) // LANE_IDS))
            every = max(checkpoint_steps, len(own) // n // 60_000 + 1)
            sums = [zlib.crc32(own[k : k + n * every].tobytes()) for k in range(0, len(own), n * every)]
            row = {"part": part, "block": block, "before": before, "n_ids": len(own), "doc_ids": [x[0] for x in held], "doc_lens": [x[1] for x in held], "coded": rans.encode(own, table, n, every), "crc32s": sums}
            return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

        for b in batches:
            for doc, n, blob, p in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "part")), strict=True):
                if held and (p != part or size + n > block_tokens):
                    yield flush()
                    block, before, held, size = block + 1, before + size, [], 0
                if p != part:
                    part, block, before = p, 0, 0
                held.append((doc, n, blob))
                size += n
        if held:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The ranges go by doc_id only: their bounds are sampled, and ids would go to the driver with the samples.
    dealt = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "ids")
    dealt.withColumn("part", F.spark_partition_id()).mapInArrow(code, BLOCK).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    return folder


SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("coded", pa.binary()), ("crc32s", pa.list_(pa.int64()))])
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def read_table(spark: SparkSession, folder: str) -> bytes:
    """The frequencies of a file set, little-endian u32; another version or a wrong checksum is an error."""
    meta = spark.read.parquet(f"{folder}/table").first()
    freq = bytes(meta.frequencies)
    if (meta.version, meta.bits) != (VERSION, rans.BITS) or zlib.crc32(freq) != meta.crc32:
        raise ValueError(f"{folder} has another format, or the checksum of its table doesn't hold")
    return freq


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with at, the ids of all documents before the block: it knows its place in its part, the parts' sums give the rest."""
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    by_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each part, and there are as many parts as shuffle partitions.
    base = by_part.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    return blocks.join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("before"))


def _stretch(row: dict, table: rans.Table, k: int) -> bytes:
    """The ids from checkpoint ``k`` of a block to the next."""
    raw = rans.decode(row["coded"], table, k, k + 1).tobytes()
    if zlib.crc32(raw) != row["crc32s"][k]:
        raise ValueError(f"checksum of block {row['part']}/{row['block']} doesn't hold at checkpoint {k}")
    return raw


def _documents(docs: list, starts: list, lens: list, own: list, with_ids: bool = True) -> pa.RecordBatch:
    cols = (docs, starts, lens, list(map(zlib.crc32, own)))
    out = dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), (pa.array(c, pa.int64()) for c in cols), strict=True))
    return pa.RecordBatch.from_pydict(out | ({"ids": pa.array(own, pa.binary())} if with_ids else {}))


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """All documents of a file set: doc_id, start long (ids of all documents before it), n_tokens, ids_crc32 and, ``with_ids``, ids (little-endian u32).

    A stretch whose checksum doesn't hold fails the job. Without ids they are decoded and checked all the same, but stay in
    the worker.
    """
    shared = spark.sparkContext.broadcast(read_table(spark, folder))

    def decode(batches):
        table = rans.Table(np.frombuffer(shared.value, "<u4"))
        for batch in batches:
            for k in range(batch.num_rows):  # a block at a time, so a task holds the ids of one
                (row,) = batch.slice(k, 1).to_pylist()
                raw = b"".join(_stretch(row, table, c) for c in range(len(row["crc32s"])))
                ends = np.cumsum(row["doc_lens"]).tolist()
                view = raw if with_ids else memoryview(raw)
                own = [view[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]
                yield _documents(row["doc_ids"], [row["at"] + e - n for e, n in zip(ends, row["doc_lens"], strict=True)], row["doc_lens"], own, with_ids)

    return _placed(spark, folder).mapInArrow(decode, DOCUMENT if with_ids else DOCUMENT.removesuffix(", ids binary"))


def read_documents(wanted: DataFrame, folder: str) -> DataFrame:
    """As ``read``, of the documents in ``wanted`` (doc_id) only. Of their blocks, only the stretches that hold them are decoded.

    A null doc_id is never found; one that is asked for twice comes once.
    """
    spark = wanted.sparkSession
    shared = spark.sparkContext.broadcast(read_table(spark, folder))
    blocks = _placed(spark, folder)
    index = blocks.select("part", "block", F.posexplode("doc_ids").alias("k", "doc_id")).join(wanted.select("doc_id").distinct(), "doc_id")
    asked = index.groupBy("part", "block").agg(F.sort_array(F.collect_list("k")).alias("asked"))

    def decode(batches):
        table = rans.Table(np.frombuffer(shared.value, "<u4"))
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                ends = np.cumsum(row["doc_lens"])
                marks = rans.checkpoints(row["coded"])  # ids before each
                held: dict[int, bytes] = {}
                docs, starts, lens, own = [], [], [], []
                for d in row["asked"]:
                    end, n = int(ends[d]), row["doc_lens"][d]
                    first, last = (int(np.searchsorted(marks, v, "right")) - 1 for v in (end - n, max(end - n, end - 1)))
                    held = {c: held.get(c) or _stretch(row, table, c) for c in range(first, last + 1)}
                    raw, skip = b"".join(held.values()), 4 * (end - n - int(marks[first]))
                    docs, starts, lens, own = [*docs, row["doc_ids"][d]], [*starts, row["at"] + end - n], [*lens, n], [*own, raw[skip : skip + 4 * n]]
                yield _documents(docs, starts, lens, own)

    return blocks.join(asked, ["part", "block"]).mapInArrow(decode, DOCUMENT)
