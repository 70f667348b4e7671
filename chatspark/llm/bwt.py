"""Repeated substrings of a set of byte strings by merging Burrows-Wheeler transforms.

The strings are dealt to shards; each shard is sorted alone and gives its transform. The merged
order is found by refining an interleave of the shards: starting from shard order, each pass sends
every entry, in the present order, to the place of its preceding symbol, which sorts the suffixes by
one symbol more. Entries that parted in an earlier pass, or by their symbol in this one, bound the
common prefixes. No suffix of a shard is compared with another shard's.

A symbol is a run of `step` bytes, numbered by its hash, and a pass moves `step` bytes back, so that
prefixes of `length` bytes take length / step passes. Any numbering serves: equal prefixes stay together.
"""

from __future__ import annotations

import numpy as np

from chatspark.llm.seqhash import byte_grams

STEP = 40


def _symbols(text: np.ndarray, step: int) -> np.ndarray:
    """Hash of the `step` bytes at each place of the cyclic text."""
    return byte_grams(np.resize(text, len(text) + step - 1), step)


def _stable(keys: np.ndarray) -> np.ndarray:
    return np.argsort(keys, kind="stable")  # a radix sort for 16-bit keys


def shard_order(symbols: np.ndarray, passes: int, step: int) -> np.ndarray:
    """The cyclic suffixes of a shard in the order of their first `passes` symbols."""
    n = len(symbols)
    order = np.arange(n)
    for j in reversed(range(passes)):
        order = order[_stable(symbols[(order + step * j) % n])]
    return order


def merge(transforms: list[np.ndarray], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each entry of the merged order, mask of the entries that begin a new prefix of `passes` symbols)."""
    sizes = [len(t) for t in transforms]
    n = sum(sizes)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), sizes)
    group = np.zeros(n, np.int32)
    first = np.zeros(n, bool)
    symbol = np.empty(n, transforms[0].dtype)
    for _ in range(passes):
        for i, t in enumerate(transforms):
            symbol[shard == i] = t
        order = _stable(symbol)
        shard, group, moved = shard[order], group[order], symbol[order]
        first[0] = True
        first[1:] = (moved[1:] != moved[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(first, dtype=np.int32)
    return shard, first


def repeated_starts(strings: list[bytes], weights: list[int], length: int, shards: int = 2, step: int = STEP) -> list[np.ndarray]:
    """For each string the starts whose next `length` bytes begin at places of the strings of total weight 2 or more.

    `length` is a multiple of `step`.
    """
    passes = length // step
    shards = max(1, min(shards, len(strings)))
    owner, local, symbols = [], [], []
    for s in range(shards):
        mine = np.arange(s, len(strings), shards)
        parts = [np.frombuffer(strings[i], np.uint8) for i in mine]
        size = np.array([len(p) for p in parts])
        owner.append(np.repeat(mine, size))
        local.append(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        symbols.append(_symbols(np.concatenate(parts), step))
    every, numbers = np.unique(np.concatenate(symbols), return_inverse=True)
    numbers = numbers.astype(np.uint16 if len(every) <= 1 << 16 else np.int32)
    sizes = np.array([len(s) for s in strings])
    transforms, places, at = [], [], 0
    for s in range(shards):
        own = numbers[at : at + len(symbols[s])]
        at += len(own)
        order = shard_order(own, passes, step)
        transforms.append(own[(order - step) % len(own)])
        places.append(order)
    shard, first = merge(transforms, passes)
    string, start = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
    for s in range(shards):
        mine = shard == s
        string[mine], start[mine] = owner[s][places[s]], local[s][places[s]]
    whole = start + length <= sizes[string]
    group = np.cumsum(first) - 1
    weight = np.bincount(group, np.where(whole, np.asarray(weights)[string], 0))
    hit = whole & (weight[group] >= 2)
    mark = np.zeros(int(sizes.sum()), bool)
    base = np.cumsum(sizes) - sizes
    mark[base[string[hit]] + start[hit]] = True
    return [np.flatnonzero(x) for x in np.split(mark, base[1:])]
