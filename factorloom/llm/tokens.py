"""Encoding with public tokenizers inside tasks."""

from __future__ import annotations

import ctypes
import gc
import itertools
import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

#: Texts are cut where pre-tokens always end, and pieces that many texts share are encoded once: before ASCII white space
#: that follows anything but white space, and after a run of letters that no further letter can follow.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_RUN = re.compile(rf"[ \t-\r]*(?:[{_LETTERS}]++(?![^\x00-\x7f])|[^ \t-\r{_LETTERS}][^ \t-\r]*|[^ \t-\r]+)|[ \t-\r]+")
_OTHER_SPACE = re.compile(r"[^\S \t-\r]")
#: Runs that a worker remembers, by count and by length; further ones are encoded each time.
CACHE_RUNS, CACHE_CHARS = 500_000, 40

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, one byte string per text."""

    def __init__(self, path: str, most_runs: int = CACHE_RUNS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.most_runs = most_runs
        self.cache: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = list(itertools.accumulate(map(len, ids), initial=0))
        flat = np.fromiter(itertools.chain.from_iterable(ids), dtype="<u4", count=ends[-1]).tobytes()
        return [flat[4 * a : 4 * b] for a, b in itertools.pairwise(ends)]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        cache = self.cache
        runs = [_RUN.findall(t) if not _OTHER_SPACE.search(t) else [t] for t in texts]
        new = list(set().union(*runs).difference(cache))
        cache.update(zip(new, self._encode(new), strict=True))
        out = [b"".join(map(cache.__getitem__, r)) for r in runs]
        full = len(cache) > self.most_runs
        for k in new:
            if full or len(k) > CACHE_CHARS:
                del cache[k]
        return out


def encoder(path: str, most_runs: int = CACHE_RUNS) -> Encoder:
    """The worker's encoder for a tokenizer file; it outlives tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, most_runs)
    return _encoders[path]


def trim() -> None:
    """Gives this process's free memory to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def forget() -> None:
    """Gives a worker's encoders back, and its free memory to the machine, before it turns to another memory-hungry operator."""
    if _encoders:
        _encoders.clear()
        gc.collect()
    trim()


def slices(texts: Sequence[str | None], most_chars: int = 1_000_000, most: int = 300):
    """Consecutive (from, to) of bounded size, so that a batch of long texts isn't held in full as ids."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most_chars or i - start + 1 >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
