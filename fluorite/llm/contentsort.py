"""Exact duplicates by sorting the texts themselves.

Every text is normalised (a run of white space becomes one space) and dealt by ranges: Spark samples the keys, picks
splitters and sends each row to its range. A key is the text's first bytes, its digest and the row's id, so it has a
bounded size however long the text is, texts that begin alike still spread over ranges, and so do the rows of one text, however
many they are. Each range is sorted on disk where memory ends; equal texts are then neighbours, and each row's whole text is
compared with that of the row before it. A range's first and last text are compared with those of its neighbours, so a group
that spans ranges is joined. Texts move once; what follows moves an id and a digest for each row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fluorite.llm.common import stage

#: Bytes of a text that lead its key.
PREFIX_BYTES = 64

ROWS = "doc_id long, sha string, part int, run long, head boolean, edge int, edge_text binary"


def normalised(text: Column) -> Column:
    """The text's bytes with each run of the six ASCII white-space characters as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ").cast("binary")


def _neighbours(batches):
    """Rows in order: numbers runs of equal texts. Ends with the range's first and last text as rows with ``edge`` 0 and 1."""
    run, first, last, part = -1, None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        text = b.column("norm")
        same = np.zeros(b.num_rows, bool)
        same[1:] = pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
        head = text[0].as_py()
        same[0] = last is not None and last == head
        runs = run + np.cumsum(~same)
        if first is None:
            first, part = head, b.column("part")[0].as_py()
        run, last = int(runs[-1]), text[len(text) - 1].as_py()
        none = [pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sha"), b.column("part"), pa.array(runs, pa.int64()), pa.array(~same), *none], names=[f.split()[0] for f in ROWS.split(", ")])
    if first is not None:
        edges = {"part": pa.array([part, part], pa.int32()), "run": pa.array([0, run], pa.int64()), "edge": pa.array([0, 1], pa.int32()), "edge_text": pa.array([first, last], pa.binary())}
        gone = {"doc_id": pa.nulls(2, pa.int64()), "sha": pa.nulls(2, pa.string()), "head": pa.nulls(2, pa.bool_())}
        yield pa.RecordBatch.from_pydict({c: (edges | gone)[c] for c in (f.split()[0] for f in ROWS.split(", "))})


def _chains(edges: DataFrame) -> list[tuple[int, int, int, int]]:
    """(part, run, part and run of the group's first run) of each run in a group that spans ranges; a few rows for each range."""
    order = edges.where("edge = 0").select("part").withColumn("next", F.lead("part").over(W.orderBy("part")))
    first = edges.where("edge = 0").select(F.col("part").alias("next"), F.col("edge_text").alias("first_text"))
    ends = edges.where("edge = 1").select("part", "run", F.col("edge_text").alias("last_text"))
    met = ends.join(order, "part").join(first, "next", "left").select("part", "run", "next", F.coalesce(F.col("last_text") == F.col("first_text"), F.lit(False)).alias("goes_on"))
    root: dict[tuple[int, int], tuple[int, int]] = {}
    for r in sorted(met.collect()):
        if r.goes_on:
            own = root.setdefault((r.part, r.run), (r.part, r.run))
            root[r.next, 0] = own
    return [(*k, *v) for k, v in root.items()]


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id (of the row that stays), group_size, kept and text_sha256 (of the normalised text), for each row.

    Of equal texts the row with the smallest doc_id stays; of several with that id, one. Null and empty texts are equal; a text
    of white space alone is one space. A null doc_id comes after all others: its row stays only if no row with an id has its text,
    and keep_id is null then. Texts may have any length; other columns are ignored, whatever their names; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(F.col(text)).alias("norm"))
    rows = rows.withColumns({"prefix": F.substring("norm", 1, PREFIX_BYTES), "sha": F.sha2("norm", 256)})
    last = F.col("doc_id").asc_nulls_last()
    dealt = rows.repartitionByRange("prefix", "sha", last).withColumn("part", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions("prefix", "sha", "norm", last).select("doc_id", "norm", "sha", "part")
    out = stage(dealt.mapInArrow(_neighbours, ROWS))
    rows = out.where("edge IS NULL")
    chains = spark.createDataFrame(_chains(out.where("edge IS NOT NULL")), "part int, run long, root_part int, root_run long")

    runs = rows.groupBy("part", "run").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).join(F.broadcast(chains), ["part", "run"], "left")
    own = runs.where("root_part IS NULL AND n > 1").select("part", "run", F.col("n").alias("group_size"), F.col("first_id").alias("keep_id"), F.lit(True).alias("leads"))
    linked = stage(runs.where("root_part IS NOT NULL"))
    # At most two runs of each range are linked.
    whole = linked.groupBy("root_part", "root_run").agg(F.sum("n").alias("group_size"), F.min("first_id").alias("keep_id"))
    over = linked.join(F.broadcast(whole), ["root_part", "root_run"])
    over = over.select("part", "run", "group_size", "keep_id", ((F.col("part") == F.col("root_part")) & (F.col("run") == F.col("root_run"))).alias("leads"))
    # A run lies in one range, so no key of this join holds more rows than a range has.
    found = rows.join(own.unionByName(over), ["part", "run"], "left")
    grouped = F.col("group_size").isNotNull()
    return found.select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("head") & F.coalesce("leads", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
