"""Simple-8b: as many ids as fit in each 64-bit word.

A word is a 4-bit selector (the low bits) and 60 bits of ids of equal width.
Selector 0 is an escape: the other 60 bits are the place of an id of more than
60 bits in the list at the end. Ids are cut into blocks; the word and escape
offsets of each block stand in front, so blocks can be decoded alone, and all
words of one selector at once.
"""

from __future__ import annotations

import struct

import numpy as np

# fixed values: ids and bits of each id, by selector
COUNTS = (1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK = 4096
POWERS = 1 << np.arange(64, dtype=np.uint64)
MAGIC = b"S8B1"
HEAD = struct.Struct("<4sIQQQ")  # magic, ids of a block, ids, words, escapes


def _block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escaped ids of one block; the last word may have room left."""
    n = len(ids)
    choice = np.zeros(n, np.int64)
    widths = np.searchsorted(POWERS, ids, "right")  # bits of each id
    fit = np.cumsum(np.bincount(widths, minlength=65))
    for s in range(len(COUNTS) - 1, 0, -1):  # ever narrower; what fits last holds most
        if fit[BITS[s]] == n:
            choice[:] = s
        elif fit[BITS[s]]:
            over = np.zeros(n + COUNTS[s] + 1, np.int32)
            np.cumsum(widths > BITS[s], out=over[1 : n + 1])
            over[n + 1 :] = over[n]
            choice[over[COUNTS[s] : n + COUNTS[s]] == over[:n]] = s
    jumps = np.asarray(COUNTS)[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += jumps[i]
    starts = np.asarray(starts, np.int64)
    used = choice[starts]
    words = used.astype(np.uint64)
    padded = np.concatenate([ids, np.zeros(240, np.uint64)])
    for s in np.unique(used).tolist():
        if s > 1:
            k = np.arange(COUNTS[s])
            parts = padded[starts[used == s][:, None] + k] << (k * BITS[s] + 4).astype(np.uint64)
            words[used == s] |= np.bitwise_or.reduce(parts, axis=1)
    escaped = starts[used == 0]
    words[used == 0] |= np.arange(len(escaped), dtype=np.uint64) << np.uint64(4)
    return words, ids[escaped]


def encode(ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, np.uint64)
    blocks = [_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    words = [b[0] for b in blocks]
    large = [b[1] for b in blocks]
    at = np.cumsum([0, *map(len, words)]).astype("<u8")
    out = np.cumsum([0, *map(len, large)]).astype("<u8")
    parts = [HEAD.pack(MAGIC, BLOCK, len(ids), int(at[-1]), int(out[-1])), at.tobytes(), out.tobytes()]
    return b"".join(parts + [w.astype("<u8").tobytes() for w in words] + [x.astype("<u8").tobytes() for x in large])


def decode(data: bytes, first: int = 0, blocks: int | None = None) -> np.ndarray:
    """The ids of ``blocks`` blocks from block ``first`` on, all by default."""
    magic, size, n, n_words, n_large = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b block file")
    total = -(-n // size)
    last = total if blocks is None else min(total, first + blocks)
    if first >= last:
        return np.zeros(0, np.uint64)
    at = np.frombuffer(data, "<u8", total + 1, HEAD.size).astype(np.int64)
    out = np.frombuffer(data, "<u8", total + 1, HEAD.size + 8 * (total + 1)).astype(np.int64)
    body = HEAD.size + 16 * (total + 1)
    words = np.frombuffer(data, "<u8", int(at[last] - at[first]), body + 8 * int(at[first])).astype(np.uint64)
    large = np.frombuffer(data, "<u8", n_large, body + 8 * n_words).astype(np.uint64)
    used = (words & np.uint64(15)).astype(np.int64)
    # where each word's ids begin: running counts, set anew at each block
    counts = np.asarray(COUNTS)[used]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(first, last), np.diff(at[first : last + 1]))
    heads = (at[first:last] - at[first])
    begin = before - before[heads][block - first] + (block - first) * size
    stop = min(n, last * size) - first * size
    ids = np.zeros(stop + 240, np.uint64)
    for s in np.unique(used).tolist():
        mine = used == s
        if s > 1:
            k = np.arange(COUNTS[s])
            values = words[mine][:, None] >> (k * BITS[s] + 4).astype(np.uint64) & np.uint64((1 << BITS[s]) - 1)
            spots = begin[mine][:, None] + k
            real = spots < np.minimum((block[mine][:, None] - first + 1) * size, stop)
            ids[spots[real]] = values[real]
        elif s == 0:
            ids[begin[mine]] = large[out[block[mine]] + (words[mine] >> np.uint64(4)).astype(np.int64)]
    return ids[:stop]
