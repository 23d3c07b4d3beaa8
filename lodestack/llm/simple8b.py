"""Simple-8b words: the top four bits select how many ids share the other sixty.

Selector s < 14 packs COUNT[s] ids of WIDTH[s] bits; selector 15 is the escape, one id too wide to share a word.
Blocks of BLOCK ids start on a word of their own; the offsets of their first words let any block be decoded alone,
and all words with one selector are decoded by one vector operation.
"""

from __future__ import annotations

import numpy as np

#: Ids in one word and bits for each, by selector.
COUNT = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTH = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
ESCAPE = 15
BLOCK = 4096


#: Bits of the numbers below 65536.
BITS = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or ids.max() < 1 << 16:
        return BITS[ids]
    return np.where(ids < 1 << 16, BITS[ids & 0xFFFF], 16 + BITS[ids >> 16]).astype(np.uint8)


def _choose(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and selector of each word, the fullest word first. All blocks are walked in step."""
    n = len(ids)
    bits = np.zeros(n + 60, dtype=np.uint8)
    bits[:n] = _bits(ids)
    # ids left in the block, as far as a word can reach
    room = np.tile(np.minimum(np.arange(BLOCK, 0, -1), 60).astype(np.uint8), -(-n // BLOCK))[:n]
    room[-60:] = np.minimum(room[-60:], np.arange(min(n, 60), 0, -1))
    # a run that fits a selector fits every later one, so the number of selectors that fit tells the first
    fitting = np.zeros(n, dtype=np.uint8)
    widest, have = bits.copy(), 1
    for s in range(len(COUNT) - 2, -1, -1):
        count = int(COUNT[s])
        while have < count:
            step = min(have, count - have)
            np.maximum(widest[:-step], widest[step:], out=widest[:-step])
            have += step
        fitting += ((widest[:n] <= int(WIDTH[s])) & (room >= count)).view(np.uint8)
    select = np.uint8(len(COUNT) - 1) - fitting
    select[bits[:n] > 30] = ESCAPE
    jump = np.append(COUNT, [1, 1]).astype(np.uint8)[select]
    at = np.arange(0, n, BLOCK)
    end = np.minimum(at + BLOCK, n)
    marked = np.zeros(n, dtype=bool)
    while len(at):
        marked[at] = True
        at = at + jump[at]
        live = at < end
        at, end = at[live], end[live]
    starts = np.flatnonzero(marked)
    return starts, select[starts]


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids below 2**32 to (words, word offset of each block)."""
    ids = np.asarray(ids, dtype=np.uint32)
    starts, select = _choose(ids)
    words = np.empty(len(starts), dtype=np.uint64)
    for s in np.unique(select).tolist():
        at = np.flatnonzero(select == s)
        first, count, width = starts[at], *((1, 60) if s == ESCAPE else (int(COUNT[s]), int(WIDTH[s])))
        word = np.full(len(at), s << 60, dtype=np.uint64)
        for j in range(count):
            word |= ids[first].astype(np.uint64) << np.uint64(j * width)
            first = first + 1
        words[at] = word
    return words, np.searchsorted(starts, np.arange(0, len(ids), BLOCK)).astype(np.uint32)


def decode(words: np.ndarray) -> np.ndarray:
    """All ids of a run of whole words."""
    select = (words >> np.uint64(60)).astype(np.int64)
    count = np.append(COUNT, [1, 1])[select]
    starts = np.cumsum(count) - count
    ids = np.empty(int(count.sum()), dtype=np.uint32)
    for s in np.unique(select).tolist():
        at = np.flatnonzero(select == s)
        n, width = (1, 60) if s == ESCAPE else (int(COUNT[s]), int(WIDTH[s]))
        mask = np.uint64((1 << width) - 1)
        for j in range(n):
            ids[starts[at] + j] = words[at] >> np.uint64(j * width) & mask
    return ids


def decode_blocks(words: np.ndarray, offsets: np.ndarray, first: int, last: int) -> np.ndarray:
    """Ids of blocks first..last-1 only."""
    end = offsets[last] if last < len(offsets) else len(words)
    return decode(words[offsets[first] : end])
