"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units of measure and names (a run of capitalised words is one) become typed placeholders, so an item asked again
with other values has the same template. Windows of template words are hash-joined with those of the benchmark; a document
is contaminated by an item if enough of the item's windows occur in it and its values fill the item's slots consistently:
each slot is aligned once, and the share of slots counts whose value and the document's belong to each other, one to one. So
wherever the item repeats a value the document must repeat one, and two values of the item aren't one in the document.
Slots are compared over the whole document first; an item that fails there is looked for again in each of its
occurrences, as a document may hold several versions of it.

Where a sentence begins, a capital doesn't tell a name. So a window has a second reading in which each capitalised word is a
name; occurrences take windows of either reading.

Besides half of an item, a passage of ``PASSAGE`` of its template words in a row counts, an item of which up to ``CHANGES`` words
were replaced, and an item too short for windows if it occurs whole with its own values.

Each row is judged by itself; rows of the same id and text count once. Words are kept for documents with enough windows alone,
one row for each, and only the slices that windows and alignments ask for leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fluorite.llm.common import stage

#: Units that may follow a number.
UNITS = "km|m|cm|mm|kg|g|mg|lb|lbs|oz|l|ml|miles?|feet|foot|inch(?:es)?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|meters?|metres?|grams?|litres?|liters?"
NUMBER = r"\p{Nd}++(?:[.,:]\p{Nd}++)*+"
#: Placeholders hold a letter that no lower-cased text has, so words of a text can't be taken for them.
NUM, UNIT, NAME = "0N", "0U", "0A"
#: Above so many benchmark windows the join shuffles instead of broadcasting; a window takes about 60 bytes.
MAX_BROADCAST_WINDOWS = 500_000
#: Keys of documents with enough windows are broadcast up to so many, 16 bytes each; beyond that texts are dealt by key.
MAX_BROADCAST_DOCS = 2_000_000
#: An occurrence may be out of step with itself by so many words: a name of two words for one, a word put in.
SLACK = 8
#: So many template words in a row are a leak, however long the item is.
PASSAGE = 13
#: So many words of an item may have been replaced; fewer in one under 15 words, where no window might be left to find it by.
CHANGES = 2


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row, though a lambda in ``use`` reads it for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def words(text: Column) -> Column:
    """A text's words; a slot's word is its placeholder, an underscore and its value."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    # Names: capitalised words after a word in lower case, so not at the start of a sentence; those that follow are one name.
    t = F.regexp_replace(t, r"(?<=\p{Ll}[,;]?\x20)\p{Lu}\p{L}+", "0A_$0")
    t = F.regexp_replace(t, r"\x200A_(?<=0A_\p{L}{1,40}\x200A_)", "_")
    t = F.regexp_replace(t, rf"(?i)({NUMBER})\s*(%|(?:{UNITS})\b)", " 0N_$1 0U_$2 ")
    t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{Nd}}_.,:]){NUMBER}(?![\p{{L}}_])", " 0N_$0 ")
    return F.regexp_extract_all(t, F.lit(r"0A_[\p{L}_]+|0[NU]_\S+|[\p{L}\p{M}]+|\p{Nd}+"), F.lit(0))


def template(word: Column) -> Column:
    return F.when(word.rlike("^0[NUA]_"), F.substring(word, 1, 2)).otherwise(F.lower(word))


def slot(word: Column) -> Column:
    """A word in the second reading: a capitalised one is a name."""
    return F.when(word.rlike(r"^\p{Lu}\p{L}"), F.concat(F.lit("0A_"), word)).otherwise(word)


def windows(text: Column, size: int) -> Column:
    """array of pos, h and plain: hash of the template words of each window, and again, with plain false, in its second
    reading if that differs; empty for a text of fewer words."""
    hashed = F.transform(words(text), lambda w: F.struct(F.xxhash64(template(w)).alias("t"), w.rlike(r"^\p{Lu}\p{L}").alias("c")))
    name = F.xxhash64(F.lit(NAME))

    def of(h: Column) -> Column:
        n = F.size(h) - (size - 1)
        at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
        word = lambda i, k: F.get(h, i + k)
        plain = lambda i: F.struct(i.alias("pos"), F.xxhash64(*[word(i, k)["t"] for k in range(size)]).alias("h"), F.lit(True).alias("plain"))
        second = lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.when(word(i, k)["c"], name).otherwise(word(i, k)["t"]) for k in range(size)]).alias("h"), F.lit(False).alias("plain"))
        capital = lambda i: F.exists(F.slice(h, i + 1, size), lambda x: x["c"])
        return F.concat(F.transform(at, plain), F.transform(F.filter(at, capital), second))

    return let(hashed, of)


def occurrences(hits: DataFrame) -> DataFrame:
    """KEYS, at, pos, doc_pos: for each offset between item and document at which a window is met, the occurrence there.

    It takes each window of the item at the offset nearest to its own, up to ``SLACK`` away, and each place of the document
    once, so a template that repeats inside itself doesn't borrow the values of its neighbours.
    """
    width = SLACK + 1
    bucket = F.floor(F.col("at") / width)
    hits = hits.withColumn("at", F.col("doc_pos") - F.col("pos"))
    anchors = hits.select(*KEYS, "at").distinct().withColumn("bucket", F.explode(F.sequence(bucket - 1, bucket + 1)))
    near = hits.select(*KEYS, "pos", "doc_pos", F.col("at").alias("own"), F.floor(F.col("at") / width).alias("bucket")).join(anchors, [*KEYS, "bucket"])
    off = F.abs(F.col("own") - F.col("at"))
    near = near.where(off <= SLACK)
    near = near.groupBy(*KEYS, "at", "pos").agg(F.min(F.struct(off.alias("off"), "doc_pos")).alias("m"))
    near = near.groupBy(*KEYS, "at", "m.doc_pos").agg(F.min(F.struct("m.off", "pos")).alias("m"))
    return near.select(*KEYS, "at", "m.pos", "doc_pos")


def passages(hits: DataFrame, least: int) -> DataFrame:
    """KEYS, at, run, pos, doc_pos: runs of ``least`` or more windows that follow each other in both texts."""
    keys = [*KEYS, "at"]
    rows = hits.withColumn("at", F.col("doc_pos") - F.col("pos"))
    rows = rows.withColumn("run", F.col("pos") - F.row_number().over(W.partitionBy(*keys).orderBy("pos")))
    return rows.withColumn("n", F.count("*").over(W.partitionBy(*keys, "run"))).where(F.col("n") >= least).drop("n")


def slices(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """``asked`` (DOC, begin, n and others) with w, the document's words from begin on, n of them; null before its start.

    A document's requests gather in one row and meet its words once.
    """
    rest = [c for c in asked.columns if c not in DOC]
    lists = asked.groupBy(*DOC).agg(F.collect_list(F.struct(*rest)).alias("asked")).join(texts, DOC)

    def cut(a: Column) -> Column:
        missing = F.least(F.greatest(-a["begin"], F.lit(0)), a["n"]).cast("int")
        own = F.slice("doc_words", (F.greatest(a["begin"], F.lit(0)) + 1).cast("int"), (a["n"] - missing).cast("int"))
        return F.struct(*[a[c].alias(c) for c in rest], F.concat(F.array_repeat(F.lit(None).cast("string"), missing), own).alias("w"))

    return lists.select(*DOC, F.inline(F.transform("asked", cut)))


def slot_pairs(hits: DataFrame, texts: DataFrame, item_slices: DataFrame, size: int, read=lambda word: word) -> DataFrame:
    """``hits`` with slot (its place in the item), value and doc_value, for each slot of each window."""
    asked = hits.select(*DOC, F.col("doc_pos").alias("begin")).distinct().withColumn("n", F.lit(size))
    cut = slices(asked, texts).select(*DOC, F.col("begin").alias("doc_pos"), "w")
    both = hits.join(cut, [*DOC, "doc_pos"]).join(item_slices, ["item_id", "pos"])
    pairs = F.zip_with(F.transform("item_w", lambda w, k: F.struct(w.alias("w"), k.alias("k"))), "w", lambda a, b: F.struct((F.col("pos") + a["k"]).alias("slot"), read(a["w"]).alias("value"), read(b).alias("doc_value")))
    return both.select(*hits.columns, F.inline(F.filter(pairs, _both_slots)))


def _both_slots(p: Column) -> Column:
    return F.coalesce(p["value"].rlike("^0[NUA]_") & p["doc_value"].rlike("^0[NUA]_"), F.lit(False))


def agreements(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """n_slots and agreement for each value of ``keys``.

    Of a slot's pairs the one that most windows give counts. A slot holds if its pair of values is the most frequent one both of its
    value and of its document's value; agreement is the share of slots that hold.
    """
    each = pairs.groupBy(*keys, "slot", "value", "doc_value").agg(F.count("*").alias("n"))
    # Ties go to the item's own value, then to the smaller one.
    other = (F.col("value") != F.col("doc_value")).alias("other")
    each = each.groupBy(*keys, "slot", "value").agg(F.min(F.struct((-F.col("n")).alias("n"), other, "doc_value")).alias("m"))
    values = each.groupBy(*keys, "value", F.col("m.doc_value").alias("doc_value")).agg(F.count("*").alias("n"))
    first = lambda by, tie: F.row_number().over(W.partitionBy(*keys, by).orderBy(F.col("n").desc(), other, tie)) == 1
    values = values.withColumn("a", first("value", "doc_value")).withColumn("b", first("doc_value", "value"))
    return values.groupBy(*keys).agg(F.sum("n").alias("n_slots"), (F.sum(F.when(F.col("a") & F.col("b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))


def aligned(hits: DataFrame, texts: DataFrame, item: DataFrame, totals: DataFrame, size: int) -> DataFrame:
    """KEYS, at and pairs (of all slot values) where the whole item but its replaced words stands in the document."""
    met = hits.withColumn("at", F.col("doc_pos") - F.col("pos")).groupBy(*KEYS, "at").agg(F.count("*").alias("met"))
    met = met.join(totals.select("item_id", "n_pos", "changes"), "item_id").where((F.col("met") >= 1) & (F.col("met") >= F.col("n_pos") - size * F.col("changes")))
    met = met.join(item, "item_id")
    cut = slices(met.select(*KEYS, F.col("at").alias("begin"), F.size("item_words").alias("n")), texts).select(*KEYS, F.col("begin").alias("at"), "w")
    met = met.join(cut, [*KEYS, "at"])
    same = lambda a, b: F.coalesce((template(a) == template(b)) | (template(slot(a)) == template(slot(b))), F.lit(False))
    differ = F.size(F.filter(F.zip_with("item_words", "w", same), lambda x: ~x))
    met = met.where(differ <= F.col("changes"))
    place = F.transform("item_words", lambda w, k: F.struct(w.alias("w"), k.alias("k")))
    pairs = F.zip_with(place, "w", lambda a, b: F.struct(a["k"].alias("slot"), slot(a["w"]).alias("value"), slot(b).alias("doc_value")))
    return met.select(*KEYS, "at", F.filter(pairs, _both_slots).alias("pairs"))


def short_items(doc: DataFrame, item: DataFrame, size: int) -> DataFrame:
    """Items of fewer than ``size`` words that occur whole, in their own values, as rows of ``contaminated``."""
    exact = F.transform(words(F.col("text")), lambda w: F.lower(F.regexp_replace(slot(w), "^0[NUA]_", "")))
    slots = F.size(F.filter(words(F.col("text")), lambda w: w.rlike("^0[NUA]_"))).cast("long")
    item = item.select("item_id", exact.alias("w"), slots.alias("n_slots")).withColumn("n", F.size("w")).where((F.col("n") > 0) & (F.col("n") < size))
    item = stage(item.select("item_id", "n", "n_slots", F.xxhash64(F.array_join("w", " ")).alias("h")).distinct())
    lengths = sorted(r.n for r in item.select("n").distinct().collect())  # at most size - 1

    def of(w: Column) -> Column:
        cut = lambda n: lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.array_join(F.slice(w, i + 1, n), " ")).alias("h"))
        at = lambda n: F.when(F.size(w) >= n, F.sequence(F.lit(0), F.greatest(F.size(w), F.lit(n)) - n)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.concat(*[F.transform(at(n), cut(n)) for n in lengths]))

    found = doc.select(*DOC, F.inline(let(exact, of))) if lengths else doc.select(*DOC, F.lit(0).alias("n"), F.lit(0).cast("long").alias("h")).limit(0)
    found = found.join(F.broadcast(item) if item.count() <= MAX_BROADCAST_WINDOWS else item, ["n", "h"]).select(*KEYS, "n_slots").distinct()
    return found.select(*KEYS, F.lit(1).cast("long").alias("n_matched"), F.lit(1).cast("long").alias("n_windows"), F.lit(1.0).alias("coverage"), "n_slots", F.lit(1.0).alias("agreement"))


#: A document row: its id (a null as zero) and a hash of id and text, odd for a null id. With the item, a pair to judge.
DOC = ["doc", "row"]
KEYS = [*DOC, "item_id"]


def _doc_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    known = F.col(doc_id).isNotNull()
    zero = F.lit("0").cast(docs.schema[doc_id].dataType)
    row = F.shiftleft(F.shiftrightunsigned(F.xxhash64(doc_id, text), 1), 1) + F.when(known, 0).otherwise(1)
    return docs.select(F.coalesce(F.col(doc_id), zero).alias("doc"), row.alias("row"), F.col(text).alias("text"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", size: int = 5, min_coverage: float = 0.5, min_agreement: float = 0.6) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, coverage, n_slots and agreement of each contaminated document and item.

    coverage: the part of the item's windows that occur in the document. agreement: the share of slots that hold (see
    ``agreements``); 1 without slots. It is that of the whole document, or else of the best occurrence, passage or alignment
    that holds enough of the item.

    A text of fewer than ``size`` words has no windows, an empty or null one has no words; an item of fewer must occur whole,
    in its own values; texts may have any length. Rows with the same id and text count once; of rows with the same id, or with
    none, and other texts each is judged and returned by itself, so an id may come twice. So is each of an item id's texts;
    items without an id don't count. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    item = items.select(F.col(item_id).alias("named"), F.col(text).alias("text")).where("named IS NOT NULL").distinct()
    item = stage(item.withColumn("item_id", F.monotonically_increasing_id()))
    item_windows = stage(item.select("item_id", F.inline(windows(F.col("text"), size))).distinct())
    totals = item_windows.where("plain").groupBy("item_id").agg(F.count_distinct("h").alias("n_windows"), F.count_distinct("pos").alias("n_pos"))
    totals = stage(totals.withColumn("changes", F.least(F.lit(CHANGES), F.floor((F.col("n_pos") - 1) / size))))
    # The benchmark's size is checked; beyond the bound both sides are dealt by window.
    right = F.broadcast(item_windows) if item_windows.count() <= MAX_BROADCAST_WINDOWS else item_windows
    doc = _doc_rows(docs, doc_id, text)
    met = doc.select(*DOC, F.inline(windows(F.col("text"), size))).withColumnsRenamed({"pos": "doc_pos", "plain": "doc_plain"}).join(right, "h")
    met = stage(met.withColumn("plain", F.col("plain") & F.col("doc_plain")).drop("doc_plain"))
    # n_matched: different windows as they are, n_met: places of the item whose window is met in either reading.
    matched = met.groupBy(*KEYS).agg(F.count_distinct(F.when(F.col("plain"), F.col("h"))).alias("n_matched"), F.count_distinct("pos").alias("n_met"))
    enough = matched.join(totals, "item_id").withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    covered = (F.col("coverage") >= min_coverage) | (F.col("n_met") >= min_coverage * F.col("n_pos"))
    traced = (F.col("n_met") >= PASSAGE - size + 1) | (F.col("n_met") >= F.col("n_pos") - size * F.col("changes"))
    enough = stage(enough.where(covered | traced))
    wanted = enough.select(*DOC).distinct()
    held = doc.join(F.broadcast(wanted) if wanted.limit(MAX_BROADCAST_DOCS + 1).count() <= MAX_BROADCAST_DOCS else wanted, DOC, "left_semi")
    texts = stage(held.select(*DOC, words(F.col("text")).alias("doc_words")).dropDuplicates(DOC))
    item_words = stage(item.select("item_id", words(F.col("text")).alias("item_words")).distinct())
    item_slices = stage(item_words.select("item_id", F.posexplode(F.transform("item_words", lambda w, k: F.slice("item_words", k + 1, size))).alias("pos", "item_w")))
    hits = met.select(*KEYS, "pos", "doc_pos", "plain").join(enough.select(*KEYS), KEYS, "left_semi")
    pooled = enough.join(agreements(slot_pairs(hits.where("plain").drop("plain"), texts, item_slices, size), KEYS), KEYS, "left")
    pooled = stage(pooled.withColumn("agreement", F.coalesce("agreement", F.lit(1.0))))
    passed = (F.col("coverage") >= min_coverage) & (F.col("agreement") >= min_agreement)

    # What fails over the whole document is judged occurrence by occurrence, in both readings.
    failed = pooled.where(~passed).drop("n_slots", "agreement")
    hits = stage(hits.drop("plain").join(failed.select(*KEYS), KEYS, "left_semi").distinct())
    held = occurrences(hits)
    whole = held.groupBy(*KEYS, "at").agg(F.count("*").alias("n_held")).join(totals, "item_id").where(F.col("n_held") >= min_coverage * F.col("n_pos")).select(*KEYS, "at")
    unit = [*KEYS, "at", "run"]
    # Runs count from -1 on; -2 is an occurrence, -3 an alignment.
    units = held.join(whole, [*KEYS, "at"], "left_semi").withColumn("run", F.lit(-2)).unionByName(passages(hits, PASSAGE - size + 1))
    units = stage(units)
    lines = stage(aligned(hits, texts, item_words, totals, size).withColumn("run", F.lit(-3)))
    pairs = slot_pairs(units, texts, item_slices, size, slot).select(*unit, "slot", "value", "doc_value").unionByName(lines.select(*unit, F.inline("pairs")))
    judged = units.select(*unit).unionByName(lines.select(*unit)).distinct().join(agreements(pairs, unit), unit, "left")
    judged = judged.withColumn("agreement", F.coalesce("agreement", F.lit(1.0))).where(F.col("agreement") >= min_agreement)
    best = judged.groupBy(*KEYS).agg(F.max(F.struct("agreement", "n_slots")).alias("m")).select(*KEYS, "m.n_slots", "m.agreement")
    out = pooled.where(passed).unionByName(failed.join(best, KEYS))
    out = out.select(*KEYS, "n_matched", "n_windows", "coverage", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), "agreement").unionByName(short_items(doc, item, size))
    out = out.join(item.select("item_id", "named"), "item_id")
    return out.select(F.when(F.col("row") % 2 == 0, F.col("doc")).alias("doc_id"), F.col("named").alias("item_id"), *[c for c in out.columns if c not in (*KEYS, "named")])
