"""Patched frame-of-reference coding of token ids, for many blocks at once.

A block holds up to 128 ids: the least id (the frame of reference), each id less that minimum
packed at the width that a percentile of them needs, and a list of the exceptions, the few that
need more: their places, and what lies above the packed bits. Of the percentiles tried, a block
takes the one that makes it smallest.

    base u32 | count u8 | width u8 | exceptions u8 | packed, count * width bits | places u8 ... | high parts u32 ...
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
HEAD = 7
PERCENTILES = (0.75, 0.9, 1.0)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def _packed(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of values below ``2 ** w`` as bytes, ``w`` bits each, lowest bits first: eight values are w bytes, put together in words."""
    eights = values.reshape(-1, 8).astype(np.uint64)
    words = np.zeros((len(eights), -(-w // 8)), np.uint64)
    for i in range(8):
        word, shift = divmod(w * i, 64)
        words[:, word] |= eights[:, i] << np.uint64(shift)
        if shift + w > 64:
            words[:, word + 1] |= eights[:, i] >> np.uint64(64 - shift)
    return words.astype("<u8").view(np.uint8)[:, :w].reshape(len(values), -1)


def _unpacked(rows: np.ndarray, w: int) -> np.ndarray:
    """The values of :func:`_packed`."""
    eights = rows.reshape(-1, w)
    wide = np.zeros((len(eights), 8 * -(-w // 8)), np.uint8)
    wide[:, :w] = eights
    words = wide.view("<u8")
    out = np.empty((len(eights), 8), np.uint64)
    for i in range(8):
        word, shift = divmod(w * i, 64)
        out[:, i] = words[:, word] >> np.uint64(shift)
        if shift + w > 64:
            out[:, i] |= words[:, word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << w) - 1)).astype(np.uint32).reshape(len(rows), BLOCK)


def encode(ids: np.ndarray, lengths: np.ndarray, percentiles: tuple[float, ...] = PERCENTILES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of the documents whose ids lie one after another in ``ids``; no block spans two documents.

    Returns the bytes of all blocks, the size of each block and the number of blocks of each document.
    """
    lengths = np.asarray(lengths, np.int64)
    per_doc = -(-lengths // BLOCK)
    n = int(per_doc.sum())
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), per_doc
    doc = np.repeat(np.arange(len(lengths)), per_doc)
    nth = np.arange(n) - (np.cumsum(per_doc) - per_doc)[doc]
    starts = (np.cumsum(lengths) - lengths)[doc] + nth * BLOCK
    counts = np.minimum(lengths[doc] - nth * BLOCK, BLOCK)
    cell = np.arange(BLOCK)
    real = cell < counts[:, None]
    values = np.asarray(ids, np.uint32)[np.where(real, starts[:, None] + cell, starts[:, None])]
    base = values.min(axis=1)
    above = np.where(real, values - base[:, None], 0).astype(np.uint32)
    # padding sorts first, so the wanted rank counts from the end of the real cells
    ordered = np.sort(above, axis=1)
    width, least = None, None
    for p in percentiles:
        rank = BLOCK - counts + np.maximum(1, np.ceil(p * counts).astype(np.int64)) - 1
        w = bit_lengths(ordered[np.arange(n), rank])
        cost = -(-counts * w // 8) + 5 * (ordered >> w[:, None].astype(np.uint32) > 0).sum(axis=1)
        width = w if width is None else np.where(cost < least, w, width)
        least = cost if least is None else np.minimum(cost, least)
    high = above >> width[:, None].astype(np.uint32)
    odd = high > 0
    exceptions = odd.sum(axis=1)
    packed = -(-counts * width // 8)
    sizes = HEAD + packed + 5 * exceptions
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(4):
        out[at + k] = (base >> np.uint32(8 * k)) & np.uint32(255)
    out[at + 4], out[at + 5], out[at + 6] = counts, width, exceptions
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        for part in np.array_split(own, max(1, len(own) // 4096)):
            rows = _packed(above[part] & np.uint32((1 << int(w)) - 1), int(w))
            kept = np.arange(rows.shape[1]) < packed[part][:, None]
            out[((at[part] + HEAD)[:, None] + np.arange(rows.shape[1]))[kept]] = rows[kept]
    block, place = np.nonzero(odd)
    nth_odd = np.arange(len(block)) - (np.cumsum(exceptions) - exceptions)[block]
    out[(at + HEAD + packed)[block] + nth_odd] = place
    where = (at + HEAD + packed + exceptions)[block] + 4 * nth_odd
    for k in range(4):
        out[where + k] = (high[block, place] >> np.uint32(8 * k)) & np.uint32(255)
    return out, sizes, per_doc


def decode(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the blocks that start at ``at`` in the bytes ``data``, one after another, and how many each has."""
    data, at = np.asarray(data, np.uint8), np.asarray(at, np.int64)
    if not len(at):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    base = sum(data[at + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    counts, width, exceptions = (data[at + k].astype(np.int64) for k in (4, 5, 6))
    packed = -(-counts * width // 8)
    above = np.zeros((len(at), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        for part in np.array_split(own, max(1, len(own) // 4096)):
            places = (at[part] + HEAD)[:, None] + np.arange(BLOCK * w // 8)
            rows = data[np.minimum(places, len(data) - 1)]
            above[part] = _unpacked(rows, int(w))
    block = np.repeat(np.arange(len(at)), exceptions)
    nth = np.arange(len(block)) - (np.cumsum(exceptions) - exceptions)[block]
    place = data[(at + HEAD + packed)[block] + nth]
    where = (at + HEAD + packed + exceptions)[block] + 4 * nth
    high = sum((data[where + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4)), np.zeros(len(block), np.uint32))
    above[block, place] |= high << width[block].astype(np.uint32)
    return (above + base[:, None])[np.arange(BLOCK) < counts[:, None]], counts
