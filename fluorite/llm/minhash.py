"""Near-duplicate detection by min-max hashing, with every link confirmed on the full shingle sets.

Each of ``permutations`` hash functions gives two signature values, the smallest and the largest hash of a document's
shingles, so a signature of twice the length costs one evaluation of each function. Both values agree between two
documents with a probability equal to their Jaccard similarity, and as the two are nearly independent, the estimate's variance is
close to that of twice as many functions. ``rows`` values make a band; documents that share a band are candidates. With 100
functions (200 values, 40 bands of 5) a pair of similarity 0.8 is missed with probability (1 - 0.8**5)**40, about 1e-7.

How the work stays in proportion to the rows:

* Documents with the same shingle set are one node, however many there are.
* A band's bucket links its members to its smallest node, its leader: at most one row for each member. Two documents that
  share a bucket share its leader, so all candidates meet in the leader's group; no pairs are listed.
* A group is dealt into blocks of a bounded number of nodes and shingles. First all pairs within each block are confirmed,
  which settles a group of one block. Of a larger one each block's linked texts then send one of them to the next round,
  where these meet in fewer blocks, and so on: near copies of one text, however many, become one component at a cost in
  proportion to their number.
* What is still apart in a group then meets what it hasn't met: the blocks of all but the largest component meet all of
  the group's blocks, two in a task, in larger blocks. Pairs that are linked by others already aren't compared.
* Two blocks' sets are compared only where they share one of their rarest shingles (``links``), so texts of one template that
  stay below the threshold cost their size and not the square of their number.
* Links are joined to components by contraction; nothing is collected by the driver. Buckets, groups and sets of copies that
  hold a large part of all rows are joined by broadcast of their few keys, so none gathers in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluorite.functions.components import connected_components
from fluorite.llm.common import attach, map_batches, stage

#: Ids of documents with candidates are broadcast up to so many, 8 bytes each.
MAX_BROADCAST_IDS = 4_000_000
#: Leaders of groups of several blocks are broadcast up to so many, 8 bytes each.
HOT_GROUPS = 1_000_000


def word_hashes(text: str | None, seen: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the words: runs of anything but the six ASCII white-space characters, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(seen) > 500_000:
        seen.clear()
    out = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh3_64_intdigest(w)
        out[k] = h
    return out


def shingle_set(text: str | None, words: int, seen: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, an empty one has none."""
    h = word_hashes(text, seen)
    n = min(words, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Signer:
    """Band keys of a shingle set: 32-bit linear permutations of the folded hashes, their minima and maxima."""

    def __init__(self, permutations: int, rows: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, permutations, dtype=np.uint32) * 2 + 1)[:, None]
        self.b = rng.integers(0, 2**32, permutations, dtype=np.uint32)[:, None]
        self.rows, self.bands = rows, 2 * permutations // rows
        self.mix = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        high = np.zeros(len(self.a), np.uint32)
        for k in range(0, len(h), 4096):
            p = self.a * h[None, k : k + 4096] + self.b
            low, high = np.minimum(low, p.min(1)), np.maximum(high, p.max(1))
        # A band takes minima and maxima of different permutations.
        values = np.concatenate([low, high])[: self.bands * self.rows].reshape(self.rows, self.bands).T.astype(np.uint64)
        out = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(self.rows):
            out = (out ^ (values[:, k] * self.mix[k])) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out.view(np.int64)


#: Shingles of a block's sets at most, 8 bytes each, beside its largest set.
BLOCK_SHINGLES = 2_000_000
#: Of sets that stay apart so many blocks' nodes meet as one block, as long as their shingles allow.
BLOCKS_APART = 16


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class _Sets:
    """Sets side by side, each in one order of their members: the rarer in all of them first."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        self.begin = np.cumsum(self.sizes) - self.sizes
        row = np.repeat(np.arange(len(sets)), self.sizes) * len(counts)
        self.codes = np.sort(row + rank[codes]) - row
        self.flag = np.zeros(len(counts), bool)

    def firsts(self, row: int, n: np.ndarray) -> np.ndarray:
        return self.codes[self.begin[row] : self.begin[row] + n[row]]

    def common(self, a: int, rows: np.ndarray) -> np.ndarray:
        """How many members set ``a`` has in common with each of ``rows``."""
        own, sizes = self.firsts(a, self.sizes), self.sizes[rows]
        self.flag[own] = True
        out = np.add.reduceat(self.flag[self.codes[_ranges(self.begin[rows], sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64)
        self.flag[own] = False
        return out


class _Postings:
    """For each member the ``rows`` that have it among their first ``n``."""

    def __init__(self, sets: _Sets, rows: np.ndarray, n: np.ndarray):
        codes = sets.codes[_ranges(sets.begin[rows], n[rows])]
        order = np.argsort(codes, kind="stable")
        self.rows = np.repeat(rows, n[rows])[order]
        self.ends = np.cumsum(np.bincount(codes, minlength=len(sets.flag)))
        self.starts = np.concatenate([[0], self.ends[:-1]])

    def of(self, codes: np.ndarray) -> np.ndarray:
        lo = self.starts[codes]
        return self.rows[_ranges(lo, self.ends[codes] - lo)]


#: So few sets are compared with each other at once.
FEW_SETS = 32


def links(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows ``left`` and rows ``right``; a link has 100 * common >= percent * union.

    Only rows that share one of their rarest members are compared. Two sets with a link differ in so few members that, of the
    larger one (x members), the rarest x - ceil(percent x / 100) + 1 and, of the other (y), the rarest y - ceil(2 percent y /
    (100 + percent)) + 1 have one in common, whatever the order, if it is one for all sets. So no link is lost.

    ``known``: components the rows are in already; two rows of one component aren't compared.
    """
    every = _Sets(sets)
    sizes, out = every.sizes, []
    label = np.arange(len(ids)) if known is None else np.unique(known, return_inverse=True)[1]
    few, same = len(ids) <= FEW_SETS, np.array_equal(left, right)
    if not few:
        as_larger, as_smaller = sizes + 1 - -(-percent * sizes // 100), sizes + 1 - -(-2 * percent * sizes // (100 + percent))
        smaller = _Postings(every, right, as_smaller)
        # Within one block a pair is met by its larger set.
        larger = None if same else _Postings(every, right, as_larger)
    for a in left:
        apart = right
        if not few:
            apart = smaller.of(every.firsts(a, as_larger))
            apart = apart[sizes[apart] <= sizes[a]]
            if larger is not None:
                more = larger.of(every.firsts(a, as_smaller))
                apart = np.concatenate([apart, more[sizes[more] > sizes[a]]])
            apart = np.unique(apart)
        apart = apart[label[apart] != label[a]]
        if not len(apart):
            continue
        common = every.common(a, apart)
        for b in apart[100 * common >= percent * (sizes[a] + sizes[apart] - common)]:
            if label[a] != label[b]:
                label[label == label[b]] = label[a]
                out.append((int(ids[a]), int(ids[b])))
    return out


def _confirm(met: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """``met``: leader, node, own, i, j and component. Links between blocks i and j of each group: leader, a, b."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        ids, own = group["node"].to_numpy(), group["own"].to_numpy()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        found = links(ids, sets, np.flatnonzero(own == i), np.flatnonzero(own == j), percent, group["component"].to_numpy()) if len(ids) > 1 else []
        return pa.table({"leader": pa.array([group["leader"][0].as_py()] * len(found), pa.int64()), "a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return stage(met.join(full, "node").groupBy("leader", "i", "j").applyInArrow(run, "leader long, a long, b long"))


def _blocks(block: int, when: Column | None = None) -> Column:
    """How many blocks a group's nodes (those for which ``when``) take."""
    one, n = (F.lit(1), F.col("n")) if when is None else (F.when(when, 1), F.when(when, F.col("n")))
    return F.ceil(F.greatest(F.coalesce(F.sum(one), F.lit(0)) / block, F.coalesce(F.sum(n), F.lit(0)) / BLOCK_SHINGLES)).cast("int")


def _within_blocks(member: DataFrame, full: DataFrame, percent: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Links within the blocks of each group (leader, node, n, component), and the groups' sizes (leader, members, blocks)."""
    size = stage(member.groupBy("leader").agg(F.count("*").alias("members"), _blocks(block).alias("blocks")))
    own = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).cast("int")
    met = attach(member, size, ["leader"], "members").withColumn("own", own).withColumn("i", F.col("own")).withColumn("j", F.col("own"))
    return _confirm(met.select("leader", "node", "component", "own", "i", "j"), full, percent), size


def _with_components(member: DataFrame, edges: DataFrame) -> DataFrame:
    to = connected_components(edges.select("a", "b")).withColumnRenamed("component", "to")
    return stage(member.drop("component").join(to, "node", "left").withColumn("component", F.coalesce("to", "node")).drop("to"))


def _between_blocks(member: DataFrame, full: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between the components of each group: the blocks of all but its largest meet each other and the largest's."""
    parts = member.groupBy("leader", "component").agg(F.count("*").alias("nodes"))
    main = parts.groupBy("leader").agg(F.max(F.struct("nodes", "component")).alias("m"), F.sum("nodes").alias("members"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("leader", "members", F.col("m.component").alias("main"))
    rows = attach(member, main, ["leader"], "members")
    aside = F.col("component") != F.col("main")
    half = max(1, block * BLOCKS_APART // 2)
    size = rows.groupBy("leader").agg(F.count("*").alias("members"), _blocks(half, aside).alias("few"), _blocks(half, ~aside).alias("many"))
    rows = attach(rows.drop("members"), size, ["leader"], "members")
    own = F.when(aside, F.pmod(F.xxhash64("node"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("node"), F.col("many"))).cast("int")
    rows = rows.withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(aside, F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)))
    return _confirm(rows.select("leader", "node", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), full, percent)


def confirmed_links(member: DataFrame, full: DataFrame, percent: int, block: int) -> DataFrame:
    """a, b: links that join what the pairs of each group (leader, node, n) with enough in common join."""
    edges, size = _within_blocks(member.withColumn("component", F.col("node")), full, percent, block, 0)
    large = size.where("blocks > 1").select("leader")
    if large.isEmpty():
        return edges.select("a", "b")
    # Groups of one block are settled; only the members of larger ones go on, without their joined texts.
    large = F.broadcast(large) if large.limit(HOT_GROUPS + 1).count() <= HOT_GROUPS else large
    member, own, every = stage(member.join(large, "leader", "left_semi")), edges.join(large, "leader", "left_semi"), [edges]
    seed, before = 0, None
    while True:
        member = _with_components(member, own)
        heads = member.groupBy("leader", "component").agg(F.min(F.struct("node", "n")).alias("m")).select("leader", "m.node", "m.n", "component")
        apart = heads.groupBy("leader").agg(F.count("*").alias("parts")).where("parts > 1").agg(F.sum("parts")).first()[0] or 0
        if not apart:
            break
        # As long as a round joins a half of what is apart, the next costs at most half of it.
        if before is not None and apart > before / 2:
            every.append(_between_blocks(member, full, percent, block))
            break
        seed, before = seed + 1, apart
        more, _ = _within_blocks(stage(heads), full, percent, block, seed)
        every.append(more)
        own = stage(own.unionByName(more))
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out.select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, permutations: int = 100, rows: int = 5, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included) and kept, for each row.

    Texts without words have no shingles and no links, null texts too. Rows with the same doc_id are one document to its
    links. A row with a null doc_id can't be referred to: it has no links, a null component_id, and is kept. An empty table
    gives no rows; other columns are ignored.
    """
    rows_in = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def sign():
        signer, seen = Signer(permutations, rows), {}

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            n, key, bands = [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, words, seen)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(signer.keys(s) if len(s) else [])
            return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n": pa.array(n, pa.int64()), "set_key": pa.array(key, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))})

        return one

    signed = stage(map_batches(rows_in, "doc_id long, n long, set_key binary, bands array<long>", sign))
    named = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    nodes = stage(classes)
    # Both columns together are one row's, so a set that many rows share doesn't gather in one task.
    first = named.join(nodes.select("set_key", F.col("node").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    banded = first.dropDuplicates(["set_key", "doc_id"]).select("doc_id", "n", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("doc_id").alias("leader"), F.count("*").alias("members")).where("members > 1")
    # The leader itself is a member of each of its groups.
    member = stage(attach(banded, leaders, ["band"], "members").select("leader", F.col("doc_id").alias("node"), "n").distinct())

    # Only texts that have a candidate are read again. Their ids are few and are broadcast, so that no other text moves; the
    # size is checked, and beyond it the texts are dealt by id.
    wanted = stage(member.select(F.col("node").alias("doc_id")).distinct())
    if wanted.count() <= MAX_BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def sets():
        seen: dict[bytes, int] = {}

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            got = [shingle_set(t, words, seen) for t in b.column("text").to_pylist()]
            return pa.RecordBatch.from_pydict({"node": b.column("doc_id"), "set_key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in got], pa.binary()), "shingles": pa.array([s.tobytes() for s in got], pa.binary())})

        return one

    full = map_batches(rows_in.join(wanted, "doc_id", "left_semi"), "node long, set_key binary, shingles binary", sets)
    # Of rows that share a doc_id, only those with the node's own set count. The sets are read once for each round.
    full = stage(full.join(nodes.select("set_key", "node"), ["set_key", "node"], "left_semi").select("node", "shingles").dropDuplicates(["node"]))
    components = connected_components(confirmed_links(member, full, percent, block)).withColumnRenamed("node", "of").withColumnRenamed("component", "to")
    named_nodes = nodes.join(components, nodes.node == components.of, "left").select("set_key", "copies", F.coalesce("to", "node").alias("component"))
    # Documents alone with their text and their links are left as they are; the join is for the others.
    linked = named_nodes.join(nodes.where("copies > 1").select("set_key"), "set_key", "left_semi").unionByName(
        named_nodes.join(components.select(F.col("of").alias("component")).distinct(), "component", "left_semi").select("set_key", "copies", "component")
    )
    return _result(signed, linked.distinct())


def _result(signed: DataFrame, linked: DataFrame) -> DataFrame:
    own: Column = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    out = attach(signed.select("doc_id", "n", "set_key"), linked, ["set_key"], "copies", "left").withColumn("component_id", own)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
