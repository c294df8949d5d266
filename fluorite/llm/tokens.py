"""Token ids of a public byte-level BPE vocabulary, by the tokenizers library.

The library splits a text into words by a fixed pattern that takes at most one space into the word that follows it, and
merges the bytes of each word on its own. So, in a text without two spaces in a row or one at its end, a space and what
follows it up to the next space (a run) always gets the same ids. Within a run, a line feed between two characters that are
no white space is a word, so the part before it and the part from it on (a line) keep their ids wherever they stand; and of
letters with marks behind, so do the letters and the marks. Each Python worker keeps the ids of the letters, runs and lines it
has met, asks the library for a batch's new ones together, and gathers the batch's ids from them; they are those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import json
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Entries whose ids a worker keeps, about 150 bytes each; beyond that it keeps those of the
#: current batch and, where they are at most half, those that came in several batches.
CACHED = 500_000
#: Bytes of text that are looked up together, and new entries that the library gets as one text.
BATCH_BYTES = 4_000_000
NEW_ENTRIES = 1000
MARKS = string.punctuation
#: A run with a line feed is cut there unless this is found: white space beside a line feed, or any other in the run.
UNCUT = r"[\t\x0B\f\r\x{85}\pZ]|^\n|\n$|\n\n"
#: After so many bytes of text a worker gives freed memory back, which the allocators else keep.
RELEASE_BYTES = 12_000_000

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _gather(flat: np.ndarray, length: np.ndarray, entries: np.ndarray) -> np.ndarray:
    start, n = np.cumsum(length) - length, length[entries]
    return flat[np.repeat(start[entries] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _list(strings: pa.Array) -> list[str]:
    """As ``to_pylist``, which takes thrice as long."""
    return strings.to_numpy(zero_copy_only=False).tolist()


class _Entries:
    """Strings and their ids. ``learn`` gives the ids of new strings and their counts."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self.at: dict[str, int] = {}
        self.flat, self.length = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        #: In how many batches each came since some were dropped last.
        self.batches = np.zeros(0, np.int32)

    def find(self, keys: list[str]) -> np.ndarray:
        """Where different ``keys`` are among the entries; new ones are added."""
        at = np.fromiter(map(self.at.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [keys[k] for k in missing.tolist()]
            flat, length = self.learn(new)
            first = len(self.length)
            at[missing] = first + np.arange(len(new))
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
            self.flat, self.length = np.concatenate([self.flat, flat]), np.concatenate([self.length, length])
            self.batches = np.concatenate([self.batches, np.zeros(len(new), np.int32)])
        self.batches[at] += 1
        return self._drop(at) if len(self.length) > CACHED else at

    def _drop(self, at: np.ndarray) -> np.ndarray:
        keep = self.batches > 1
        if keep.sum() > CACHED // 2:
            keep[:] = False
        keep[at] = True
        used = np.flatnonzero(keep)
        kept = list(itertools.compress(self.at, keep.tolist()))  # a dict keeps the order of entries
        self.at = dict(zip(kept, range(len(kept)), strict=True))
        self.flat, self.length = _gather(self.flat, self.length, used), self.length[used]
        self.batches = np.zeros(len(used), np.int32)
        return np.searchsorted(used, at)


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        split = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.by_run = self.tokenizer.normalizer is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        #: Strings that the library takes as one id wherever they stand; a text with one goes through the library whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        #: Ids that begin with a space, which a byte-level vocabulary writes as U+0120.
        self.spaced = np.array([(self.tokenizer.id_to_token(k) or "").startswith("Ġ") for k in range(self.size)])
        feed = np.frombuffer(self("\n"), "<u4")
        feeds = np.arange(self.size) == (feed[0] if len(feed) == 1 else -1)
        #: By runs and letters without their space: ids of a space and them. By lines without their line feed: ids of both.
        self.runs = _Entries(lambda new: self._learn(new, " ", self.spaced))
        self.lines = _Entries(lambda new: self._learn(new, "\n", feeds))

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()

    def batch(self, texts: pa.Array):
        """For slices of ``texts`` in order: the ids of all its texts (u4), and where each text's ids end."""
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at, released = 0, 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, "right")))
            yield self._slice(texts.slice(at, end - at))
            at = end
            if sizes[at - 1] - released >= RELEASE_BYTES or at == len(texts):
                released = sizes[at - 1]
                release_memory()

    def _learn(self, new: list[str], lead: str, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts of ``lead`` and each string. The library gets many as one text; where each begins is an id of ``leads``."""
        parts, counts = [], []
        for k in range(0, len(new), NEW_ENTRIES):
            part = new[k : k + NEW_ENTRIES]
            (got,) = self.tokenizer.encode_batch_fast([lead + lead.join(part)], add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            begin = np.flatnonzero(leads[ids])
            if len(begin) == len(part) and begin[0] == 0:
                parts.append(ids)
                counts.append(np.diff(begin, append=len(ids)))
            else:
                own = [np.frombuffer(self(lead + s), "<u4") for s in part]
                parts += own
                counts.append(np.array(list(map(len, own)), np.int64))
        return np.concatenate(parts), np.concatenate(counts)

    @staticmethod
    def _find(entries: _Entries, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """For each string: its entry, which marks follow that (-1: none), and these marks."""
        stem = pc.ascii_rtrim(strings, MARKS)
        behind = (pc.binary_length(strings).to_numpy(zero_copy_only=False) - pc.binary_length(stem).to_numpy(zero_copy_only=False)).astype(np.int64)
        plain = pc.utf8_is_alpha(stem)
        keys = pc.if_else(plain, stem, strings).dictionary_encode()
        at = entries.find(_list(keys.dictionary))[keys.indices.to_numpy()]
        # Marks are their code where one follows, else numbered from 128 on.
        ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset + 1 : strings.offset + len(strings) + 1]
        data = np.frombuffer(strings.buffers()[2] or b"\0", np.uint8)
        plain = plain.to_numpy(zero_copy_only=False)
        tail = np.where(plain & (behind > 0), data[np.maximum(ends - 1, 0)].astype(np.int64), -1)
        several = np.flatnonzero(plain & (behind > 1))
        marks = {chr(k): k for k in range(128)}
        tail[several] = [marks.setdefault(s[-n:], len(marks)) for s, n in zip(_list(strings.take(pa.array(several))), behind[several].tolist(), strict=True)]
        return at, tail, list(marks)

    def _kinds(self, kinds: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each of ``kinds``, and their counts."""
        cut = pc.match_substring(kinds, "\n")
        if pc.any(cut).as_py():
            where = pc.indices_nonzero(cut)
            cut = np.zeros(len(kinds), bool)
            cut[where.to_numpy()] = pc.invert(pc.match_substring_regex(kinds.take(where), UNCUT)).to_numpy(zero_copy_only=False)
            lists = pc.split_pattern(kinds.filter(pa.array(cut)), "\n")
            ends, pieces = lists.offsets.to_numpy(), lists.flatten()
            first = np.zeros(len(pieces), bool)
            first[ends[:-1]] = True
            runs, lines = pc.replace_with_mask(kinds, pa.array(cut), pieces.filter(pa.array(first))), pieces.filter(pa.array(~first))
            size = np.ones(len(kinds), np.int64)
            size[cut] = np.diff(ends)
        else:
            runs, lines, size = kinds, kinds.slice(0, 0), np.ones(len(kinds), np.int64)
        run, run_tail, run_marks = self._find(self.runs, runs)
        line, line_tail, line_marks = self._find(self.lines, lines)
        marks = [np.frombuffer(self(m), "<u4") for m in [*run_marks, *line_marks]]
        # One table of all: runs' entries, lines', marks, and last an empty one.
        flat = np.concatenate([self.runs.flat, self.lines.flat, *marks])
        length = np.concatenate([self.runs.length, self.lines.length, np.array([*map(len, marks), 0], np.int64)])
        n_runs, none = len(self.runs.length), len(length) - 1
        n_lines = n_runs + len(self.lines.length)
        begin = np.cumsum(size) - size
        of_run = np.zeros(size.sum(), bool)
        of_run[begin] = True
        units = np.empty((len(of_run), 2), np.int64)
        units[of_run, 0], units[of_run, 1] = run, np.where(run_tail < 0, none, n_lines + run_tail)
        units[~of_run, 0], units[~of_run, 1] = n_runs + line, np.where(line_tail < 0, none, n_lines + len(run_marks) + line_tail)
        units = units.reshape(-1)
        n = np.add.reduceat(length[units], 2 * begin) if len(kinds) else begin
        return _gather(flat, length, units), n

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " "))
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        whole = whole.to_numpy(zero_copy_only=False) if self.by_run else np.ones(len(texts), bool)
        # A text's first run follows no space, and texts that go whole aren't split: both get entries of their own.
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        ends = lists.offsets.to_numpy()
        ends = ends - ends[0]
        runs = lists.flatten()
        head = pc.if_else(pa.array(whole), texts, runs.take(pa.array(ends[:-1])))
        first = [np.frombuffer(self(s), "<u4") for s in _list(head)]
        runs = runs.dictionary_encode()
        flat, length = self._kinds(pa.concat_arrays([runs.dictionary]))
        entries = runs.indices.to_numpy().astype(np.int64)
        entries[ends[:-1]] = len(length) + np.arange(len(texts))
        length = np.concatenate([length, np.array(list(map(len, first)), np.int64)])
        upto = np.cumsum(length[entries])
        return _gather(np.concatenate([flat, *first]), length, entries), upto[ends[1:] - 1]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
