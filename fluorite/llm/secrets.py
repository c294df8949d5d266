"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidates with their places. Each candidate's value is hashed, and over the whole corpus distinct owners and
repositories of a hash are counted. A value is

* live with up to ``few_owners`` owners, in however many repositories of these: it is theirs;
* an example, widely copied, from ``many_owners`` owners on, or if more than a few owners hold it in ``many_repos`` repositories;
* shared between these: several owners, but not spread enough to be called an example.

Values of the base kinds are reported in any case, values of the further kinds only if they look live.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluorite.llm.common import attach, stage

#: Kind, pattern, group that is the value, least length of that group; base kinds first, in order of rank.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Further kinds: tokens of code hosts, chat and payment services, signed web tokens, private keys, passwords in addresses.
MORE = [
    ("issued", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})", 0, 1),
    ("signed", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}", 0, 1),
    ("address", r"://[^\s:@/]+:([^\s:@/]{6,})@", 1, 6),
]
RANK = {kind: k for k, (kind, *_) in enumerate(BASE + MORE)}
#: A text without one of a kind's strings (in lower case: assign's may have either) has no match of it.
NEEDLES = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["AKIA"],
    "issued": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "k_live_", "AIza"],
    "signed": ["eyJ"],
    "private": ["-----BEGIN "],
    "address": ["://"],
}
#: Matches of a text that are numbered in one pass.
BLOCK = 256
#: Characters of a match behind its value.
BEHIND = {"address": 1}


def _may_match(text: Column, kind: str) -> Column:
    within = F.lower(text) if kind == "assign" else text
    return reduce(lambda a, b: a | b, [F.contains(within, F.lit(n)) for n in NEEDLES[kind]]) if kind in NEEDLES else F.lit(True)


def _running(items: Column, zero: Column, step: Callable, after: Callable, kind: str, around: Callable | None = None) -> Column:
    """An array of what ``step(state, item)`` (the next state and a result) gives for each item in order; ``after`` is the next state.

    A running state in one pass would copy the results so far for each item. So items go in blocks of BLOCK: first the state
    before each block, then each block by itself. ``kind``: the result's type. ``around(block, state)`` is made once for each
    block; step then gets the block's first state and it, too.
    """

    def whole(bound: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(bound) - 1, F.lit(0)), F.lit(BLOCK)), lambda b: F.slice(bound, b + 1, F.lit(BLOCK)))
        before = F.aggregate(blocks, F.array(zero), lambda s, b: F.concat(s, F.array(F.aggregate(b, F.element_at(s, -1), after))))
        empty = F.array().cast(kind)

        def one(block: Column, start: Column) -> Column:
            def results(*more: Column) -> Column:
                def add(s: Column, item: Column) -> Column:
                    state, result = step(s["state"], item, *more)
                    return F.struct(state.alias("state"), F.concat(s["made"], F.array(result)).alias("made"))

                return F.aggregate(block, F.struct(start.alias("state"), empty.alias("made")), add)["made"]

            return F.transform(F.array(around(block, start)), lambda c: results(start, c))[0] if around else results()

        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), one))

    # Bound to a name, so that the items are made once and not for each block.
    return F.transform(F.array(items), whole)[0]


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Candidates of one kind: the pieces between matches and the matches together give the places, in code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    size = lambda a: F.transform(a, F.length)
    pieces = F.zip_with(F.zip_with(F.slice(size(gaps), F.lit(1), F.size(whole)), size(whole), lambda g, w: F.struct(g.alias("gap"), w.alias("whole"))), value, lambda p, v: F.struct(p["gap"].alias("gap"), p["whole"].alias("whole"), v.alias("value")))

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + p["gap"]
        end = start + p["whole"]
        return end, F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"))

    found = _running(pieces, F.lit(0), step, lambda at, p: at + p["gap"] + p["whole"], "array<struct<start:int,end:int,value:string>>")
    spans = F.filter(found, lambda s: F.length(s["value"]) >= least)
    named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(RANK[kind]).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))
    # Most texts have no match; only then are the pieces built.
    return F.when(_may_match(text, kind) & text.rlike(pattern), named).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>"))


def candidates(text: Column) -> Column:
    """array<struct<start, rank, end, kind, value>> by start, then rank."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_sort(reduce(F.concat, [_found(t, *k) for k in BASE + MORE]))


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repos, n_rows from rows of value_hash, owner, repo.

    Rows shrink by partial aggregation before each shuffle: to one for each owner and repository, then for each owner, then
    for each value. A null owner or repository counts as one more.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c)
    by_repo = found.select("value_hash", name("owner"), name("repo")).groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_rows"))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: str | None = None, few_owners: int = 2, many_owners: int = 5, many_repos: int = 10, into: str = "secrets") -> DataFrame:
    """``docs`` with ``into``: array<struct<start, rank, end, kind, value, n_owners, n_repos, status>> by start and rank.

    Candidates of ``MORE`` are kept if live. A null or empty text has none; texts may have any length; repeated rows are
    scanned each; an empty table gives no rows. Other columns stay; one named ``into`` is replaced.

    ``repo``: the column that names a repository; None takes owner and language, where there is a ``lang``. That is a stand-in
    for corpora that name none, and a weak one: it tells an owner's holdings in different languages apart, no more.
    A null owner or repository counts as one more.
    """
    kept = [c for c in docs.columns if c != into]
    repo_col = F.col(repo) if repo else F.concat_ws("/", F.col(owner).cast("string"), *([F.col("lang").cast("string")] if "lang" in docs.columns else []))
    row = F.struct(*[F.col(c) for c in kept])
    scanned = stage(docs.select(F.monotonically_increasing_id().alias("row_id"), row.alias("row"), F.col(owner).cast("string").alias("owner"), repo_col.alias("repo"), candidates(F.col(text)).alias("found")))
    having = scanned.where(F.size("found") > 0)
    each = having.select("row_id", "owner", "repo", F.explode("found").alias("c")).withColumn("value_hash", F.sha2(F.col("c.value"), 256))
    spread = (F.col("n_owners") >= many_owners) | (F.col("n_owners") > few_owners) & (F.col("n_repos") >= many_repos)
    status = F.when(F.col("n_owners") <= few_owners, "live").when(spread, "example").otherwise("shared")
    known = attach(each, ownership(each), ["value_hash"], "n_rows").withColumn("status", status)
    known = known.where((F.col("c.rank") < len(BASE)) | (F.col("status") == "live"))
    entry = F.struct("c.start", "c.rank", "c.end", "c.kind", "c.value", "n_owners", "n_repos", "status")
    by_row = known.groupBy("row_id").agg(F.array_sort(F.collect_list(entry)).alias("secrets"))
    none = F.array().cast(by_row.schema["secrets"].dataType)
    # Only rows with candidates move; the others go by.
    found = having.select("row_id", "row").join(by_row, "row_id", "left").select("row", F.coalesce("secrets", none).alias("secrets"))
    out = scanned.where(F.size("found") == 0).select("row", none.alias("secrets")).unionByName(found)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], F.col("secrets").alias(into))


def digest(spans: Column | str) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with the values of all spans but copied examples replaced, at their places only; values that overlap get one mark."""
    behind = lambda s: F.coalesce(*[F.when(s["kind"] == k, F.lit(n)) for k, n in BEHIND.items()], F.lit(0))
    place = lambda s: F.struct((s["end"] - behind(s) - F.length(s["value"])).alias("at"), (s["end"] - behind(s)).alias("to"))
    places = F.array_sort(F.transform(F.filter(secrets, lambda s: s["status"] != "example"), place))
    t = text.cast("string")

    most = lambda a: F.array_max(F.transform(a, lambda p: p["to"]))

    def step(upto: Column, p: Column, first: Column, near: Column) -> tuple[Column, Column]:
        gap = F.concat(F.substr(near, upto - first + 1, p["at"] - upto), F.lit(mark))
        return F.greatest(upto, p["to"]), F.when(p["at"] >= upto, gap).otherwise("")

    # A piece of a text is found by counting from its beginning: so a block's stretch of it is cut out first.
    near = lambda block, first: F.substr(t, first + 1, F.greatest(most(block) - first, F.lit(0)))
    parts = _running(places, F.lit(0), step, lambda upto, p: F.greatest(upto, p["to"]), "array<string>", near)
    done = F.concat(F.array_join(parts, ""), F.substr(t, most(places) + 1))
    return F.when(F.size(places) > 0, done).otherwise(t)
