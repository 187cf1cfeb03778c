"""Byte-level BPE over whole texts, fast because equal stretches are encoded once per worker.

The pattern of these vocabularies cuts a text before every single space that a visible character
follows, and on both sides of a line feed between two visible characters, whatever stands around
it.  The stretches between such cuts can therefore be encoded alone, and their ids joined.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, compress

import numpy as np

# the general rule for the cuts; \x1c-\x1f are white space to Python but not to the tokenizers, so
# it cuts at fewer places there, which is safe
CUT = re.compile(r"(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
RAW = "\0"  # a key that starts so stands for the rest of it, one that starts with \n for itself, any other for " " + key
# a key whose cuts on both sides are ones that the pattern makes too
PLAIN = re.compile(r"[\0\n]?(?=\S)[^\0\n]*(?<=\S)")
MEMO = 300_000


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[str, ...]:
    """Strings of the added tokens, which the library finds before any other cut."""
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())


def keys_of(text: str) -> list[str]:
    """Keys of the stretches of a text that has single spaces and line feeds between words only."""
    keys = text.replace("\n", " \n").split(" ")
    keys[0] = RAW + keys[0]
    return keys


class Rows(dict):
    """Row of each key; a key not seen before gets the next row and is remembered as new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        row = self[key] = len(self)
        return row


class Memo:
    """What ``learn`` gives for each stretch, as a ragged table that grows.

    ``learn`` takes stretches and returns their values joined, and how many each has.  When ``MEMO``
    stretches are held the table starts anew, so memory is bounded and results stay the same.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: tuple[str, ...]) -> None:
        self.learn, self.special = learn, special
        self.reset()

    def reset(self) -> None:
        self.row = Rows()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.length = np.zeros(1 << 15, np.int64)  # -1: not a key to cut at
        self.start = np.zeros(1 << 15, np.int64)

    def add(self, keys: list[str]) -> None:
        first = len(self.row) - len(keys)
        match = PLAIN.fullmatch
        good = [match(k) is not None or k[:2] == RAW + RAW for k in keys]
        if any(x in "\n".join(keys) for x in self.special):
            good = [g and (k[:2] == RAW + RAW or not any(x in k for x in self.special)) for k, g in zip(keys, good, strict=True)]
        taken = keys if all(good) else list(compress(keys, good))
        flat, lengths = self.learn(
            [k if k[0] == "\n" else k[2:] if k[:2] == RAW + RAW else k[1:] if k[0] == RAW else " " + k for k in taken]
        )
        sizes = np.full(len(keys), -1, np.int64)
        sizes[np.array(good, bool)] = lengths
        held = np.maximum(sizes, 0)
        total = int(held.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(keys) > len(self.length):
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : self.used + total] = flat
        self.length[first : first + len(keys)] = sizes
        self.start[first : first + len(keys)] = self.used + np.cumsum(held) - held
        self.used += total

    def _look(self, parts: list[list[str]]) -> np.ndarray:
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(parts)), np.int64)
        if self.row.new:
            new, self.row.new = self.row.new, []
            self.add(new)
        return rows

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The values of all stretches of ``texts`` one after the other, and how many each text has."""
        if len(self.row) > MEMO:
            self.reset()
        parts = [keys_of(t) if t and RAW not in t else [] for t in texts]
        rows = self._look(parts)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        odd = np.flatnonzero((per_text(self.length[rows] < 0, counts) > 0) | [RAW in t for t in texts])
        if len(odd):  # cut these by the general rule, or not at all where an added token occurs
            for i in odd:
                t = texts[i]
                whole = any(s in t for s in self.special)
                parts[i] = [RAW + RAW + c for c in ([t] if whole else CUT.split(t)) if c]
            rows = self._look(parts)
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
        lengths, starts = self.length[rows], self.start[rows]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)], per_text(lengths, counts)


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive runs of ``counts``."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


@lru_cache(maxsize=4)
def byte_of() -> dict[str, int]:
    """The visible characters by which byte-level vocabularies write bytes: printable Latin-1 as it
    is, the other bytes in order from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[bytes, int]:
    """Bytes of each token but the added ones, and its id."""
    with open(path, encoding="utf-8") as f:
        names, back = json.load(f)["model"]["vocab"], byte_of()
    added = specials(path)
    return {bytes(back[c] for c in name): i for name, i in names.items() if name not in added}


def ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths


@lru_cache(maxsize=2)
def encoder(path: str) -> Memo:
    """Ids, merged by rank: in these files a token's id is the rank of its merge.

    Stretches without white space but a space or a line feed in front are encoded in one go, parted
    by line feeds, which are a token of their own there.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = vocabulary(path)
    merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    special, own, feed = specials(path), load(path), ranks[b"\n"]
    simple = re.compile(r"[ \n]?\S+").fullmatch

    def learn(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not all(map(simple, texts)) or any(x in "\n".join(texts) for x in special):
            return ragged([
                own.encode(t, add_special_tokens=False).ids if any(x in t for x in special) else merge.encode_ordinary(t)
                for t in texts
            ])
        if not texts:
            return ragged([])
        led = np.fromiter((t[0] == "\n" for t in texts), bool, len(texts))
        ids = np.array(merge.encode_ordinary("\n".join([t[1:] if t[0] == "\n" else t for t in texts])), np.uint32)
        ends = np.append(np.flatnonzero(ids == feed), len(ids))
        lengths = np.diff(ends, prepend=-1) - 1
        # the line feed that ends one stretch is dropped, and one is put before those that begin with it
        ids = np.delete(ids, ends[:-1])
        starts = np.cumsum(lengths) - lengths
        return np.insert(ids, starts[led], feed), lengths + led

    return Memo(learn, special)
