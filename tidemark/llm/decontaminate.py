"""Benchmark passages in documents: the q-gram lemma over diagonal bands, then banded alignment."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ship
from .learning import slices
from .memory import tidy

Q = 14  # characters of a gram
WINDOW = 80  # characters of an item that must be found in a document
EDITS = 4  # that a window may differ by
STRIDE = 8  # between the windows of an item
BAND = 8  # diagonals that a band has, beside those it shares with the next
SLICE_CHARS = 4_000_000  # of benchmark text that one pass over the documents takes along
TEXT_AT_ONCE = 1 << 21  # characters of documents that are searched together
FILTER_BITS = 22
MULTIPLIER = 0x9E3779B97F4A7C15
WORD = re.compile(r"[^\W_]+")


def normalised(text: str) -> str:
    """Letters and digits in lower case; all else between them is one blank."""
    return " ".join(WORD.findall(text)).lower()


def origins(text: str, places: list[int]) -> list[int]:
    """Where in ``text`` the characters at the given places of its normal form come from."""
    starts, before, at = [], [], 0
    for m in WORD.finditer(text):
        starts.append(at)
        before.append((m.start(), m.end()))
        at += len(m[0].lower()) + 1
    out = []
    for p in places:
        k = int(np.searchsorted(starts, p, "right")) - 1
        a, b = before[k]
        out.append(min(a + p - starts[k], b - 1))
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q characters that begin at each place."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, span, factor, rest = None, 0, codes.astype(np.uint64), 1, MULTIPLIER, q
    while rest:  # grams of 1, 2, 4 ... characters, put together as the bits of q say
        if rest & 1:
            part = power[done:done + n]
            out = part.copy() if out is None else out * np.uint64(factor) + part
            done += span
        rest >>= 1
        if rest:
            power = power[:-span] * np.uint64(factor) + power[span:]
            span, factor = 2 * span, factor * factor * MULTIPLIER % (1 << 64)
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xD1B54A32D192ED03)


class Index:
    """The grams of some benchmark items, and of each item how long its windows are and what they must share."""

    def __init__(self, ids: list, texts: list[str], q: int = Q, window: int = WINDOW, edits: int = EDITS):
        kept = [(i, t) for i, t in zip(ids, map(normalised, texts)) if len(t) >= q]
        self.q = q
        self.ids = [i for i, _ in kept]
        self.codes = [_codes(t) for _, t in kept]
        size = np.array([len(c) for c in self.codes], np.int64)
        self.window = np.minimum(size, window)
        # fewer edits where a short item could not be told by any shared gram otherwise
        self.edits = np.minimum(edits * self.window // window, (self.window - q) // q)
        self.need = self.window - q + 1 - self.edits * q
        grams = [gram_hashes(c, q) for c in self.codes]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.hashes, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def starts(self, item: int) -> np.ndarray:
        """Where the windows of an item begin: at every STRIDE, and the last one."""
        last = len(self.codes[item]) - self.window[item]
        return np.unique(np.append(np.arange(0, last + 1, STRIDE), last))

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place in the item and place in ``codes`` of every gram they share; a long text in pieces."""
        parts = [self._hits(codes[a:a + TEXT_AT_ONCE + self.q - 1], a) for a in range(0, max(1, len(codes)), TEXT_AT_ONCE)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _hits(self, codes: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        h = h[at]
        if not len(self.hashes):
            at, h = at[:0], h[:0]
        k = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        same = self.hashes[k] == h if len(h) else np.zeros(0, bool)
        at, k = at[same], k[same]
        n = self.first[k + 1] - self.first[k]
        own = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.item[own], self.place[own].astype(np.int64), np.repeat(at + offset, n)

    def regions(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(item, window start, least diagonal of the band, text) of windows that share grams enough within a band.

        ``codes`` are texts one after the other with a character between them, ``first`` where each begins and the
        next would. Grams count together only if they are of one text.
        """
        item, place, at = self.hits(codes)
        if not len(item):
            return np.zeros((0, 4), np.int64)
        diagonal, text = at - place, np.searchsorted(first, at, "right") - 1
        band = diagonal // BAND
        # a band also holds the first diagonals of the next, as many as edits can drift
        shared = diagonal % BAND < self.edits[item]
        pairs = ((item, item), (place, place), (band, band - 1), (text, text))
        item, place, band, text = (np.concatenate([x, y[shared]]) for x, y in pairs)
        size = int(band.max() - band.min()) + 1
        group = (text * len(self.ids) + item) * size + (band - band.min())
        # an item's window cannot share more grams than its whole band
        _, back, n = np.unique(group, return_inverse=True, return_counts=True)
        enough = n[back] >= self.need[item]
        item, place, band, text, group = item[enough], place[enough], band[enough], text[enough], group[enough]
        order = np.lexsort((place, group))
        item, place, band, text, group = item[order], place[order], band[order], text[order], group[order]
        out = []
        edge = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(edge, np.append(edge[1:], len(group))):
            i = int(item[a])
            starts, own = self.starts(i), place[a:b]
            count = np.searchsorted(own, starts + self.window[i] - self.q, "right") - np.searchsorted(own, starts)
            out += [(i, s, int(band[a]) * BAND, int(text[a])) for s in starts[count >= self.need[i]]]
        return np.array(out, np.int64).reshape(-1, 4)

    def aligned(self, codes: np.ndarray, regions: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Text, item, edits, and start and end in ``codes`` of the regions whose window aligns with their text within its edits."""
        for i in np.unique(regions[:, 0]):
            own = regions[regions[:, 0] == i]
            width, edits = int(self.window[i]), int(self.edits[i])
            for part in np.array_split(own, max(1, len(own) // 512)):
                window = self.codes[i][part[:, 1:2] + np.arange(width)]
                least = part[:, 1] + part[:, 2] - edits  # of the text places that the window's first character may meet
                low, high = first[part[:, 3]], first[part[:, 3] + 1] - 1
                cost, start = banded_distance(window, codes, least, BAND + 3 * edits + 1, low, high)
                best = cost.argmin(axis=1)
                rows = np.arange(len(part))
                for r in np.flatnonzero(cost[rows, best] <= edits):
                    a, b = max(start[r, best[r]], low[r]), min(least[r] + best[r] + width, high[r])
                    yield int(part[r, 3]), int(i), int(cost[r, best[r]]), int(a), int(b)


def banded_distance(
    window: np.ndarray, codes: np.ndarray, least: np.ndarray, band: int, low: np.ndarray, high: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Edits of whole windows against any part of the text, within a band of diagonals.

    Row r of ``window`` may begin at the text places ``least[r]`` to ``least[r] + band - 1``. Returns, for each diagonal
    where an alignment may end, the least edits and the text place where it begins. The row's text lies from ``low[r]`` to
    before ``high[r]``; places beyond it match nothing.
    """
    n, width = window.shape
    far = 1 << 20
    places = least[:, None] + np.arange(band)
    cost, start = np.zeros((n, band), np.int64), places.copy()
    nothing = np.uint32(0xFFFFFFFF)
    step = np.arange(band)
    for k in range(width):
        at = places + k
        inside = (at >= low[:, None]) & (at < high[:, None])
        text = np.where(inside, codes[np.clip(at, 0, max(0, len(codes) - 1))], nothing) if len(codes) else np.full(at.shape, nothing)
        diagonal = cost + (text != window[:, k:k + 1])
        # a character of the window that the text lacks: from the next diagonal
        dropped = np.concatenate([cost[:, 1:] + 1, np.full((n, 1), far)], axis=1)
        from_drop = dropped < diagonal
        now = np.where(from_drop, dropped, diagonal)
        origin = np.where(from_drop, np.concatenate([start[:, 1:], start[:, -1:]], axis=1), start)
        # characters that only the text has: any number of diagonals on, one edit each
        level = (now - step) * band + step
        best = np.minimum.accumulate(level, axis=1)
        source = best % band
        cost = np.take_along_axis(now, source, axis=1) + step - source
        start = np.take_along_axis(origin, source, axis=1)
    return cost, start


def search(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits) of each item found in each text; places are of the whole text."""
    out = []
    forms = [normalised(t) for t in texts]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(forms[end]) <= TEXT_AT_ONCE):
            size += len(forms[end]) + 1
            end += 1
        # the character between two texts is in no item, so no gram spans two
        codes = _codes("\0".join(forms[at:end]))
        first = np.cumsum([0, *(len(f) + 1 for f in forms[at:end])])
        regions = index.regions(codes, first)
        if len(regions):
            found: dict[tuple[int, int], list[int]] = {}
            for t, i, cost, a, b in index.aligned(codes, regions, first):
                a, b = a - int(first[t]), b - int(first[t])
                own = found.setdefault((at + t, i), [a, b, cost])
                found[at + t, i] = [min(own[0], a), max(own[1], b), min(own[2], cost)]
            for (t, i), (a, b, cost) in sorted(found.items()):
                a, b = origins(texts[t], [a, b - 1])
                out.append((t, i, a, b + 1, cost))
        at = end
    return out


_INDEXES: dict[str, Index] = {}


def _index_of(items: list[tuple], name: str) -> Index:
    """The index of a slice, built once in a worker; the last one is kept, under the slice's name."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index([i for i, *_ in items], [t for _, t, *_ in items])
    return _INDEXES[name]


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """A row for each document and benchmark item found in it: key, item, start, end and edits.

    Texts are compared as letters and digits in lower case, with one blank for all else between them. An item is found
    if one of its windows of 80 characters, taken at every eighth and at the end, aligns with some part of the document
    by at most 4 edits. Each such part shares at least 80 - 14 + 1 - 4 * 14 = 11 grams of 14 characters with the window
    on neighbouring diagonals; only such regions are aligned, within their band. An item shorter than a window is one
    window, with as many edits in proportion, and no more than its grams can bear; one under 14 characters has no gram
    and is never found. start and end are in code points of the whole text and span all windows found; edits are those
    of the best one.

    The distinct items go along with the tasks in slices of about ``slice_chars`` characters (dealt by a hash, never more
    than twice that, but for an item that is longer alone), as many as it takes, each with a pass over the documents. Null or empty texts on either side match nothing; rows
    without a key or item are searched and found all the same. Repeated items and documents give repeated rows. An empty
    table gives no rows. Other columns are not looked at.
    """
    items, n_slices = _slices(benchmark, item, item_text, slice_chars)
    source = docs.select(F.col(key).alias("__id"), F.col(text).cast("string").alias("__text"))
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)["item_id"]

    def passed(held) -> DataFrame:
        name = uuid.uuid4().hex

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index_of(held.value, name)
            ids = pa.array(index.ids, kind)
            times = [n for _, t, n in held.value if len(normalised(t)) >= Q]  # an item's rows, of those that the index has
            for batch in (part for whole in batches for part in slices(whole)):
                found = [f for f in search(index, [t or "" for t in batch.column("__text").to_pylist()]) for _ in range(times[f[1]])]
                columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id").take(columns[0]), ids.take(columns[1]), *columns[2:]], [key, "item_id", "start", "end", "edits"]
                )

        kind = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
        return source.mapInArrow(run, f"`{key}` {kinds[0]}, item_id {kinds[1]}, start long, end long, edits long")

    out = None
    for n in range(n_slices):
        part = passed(docs.sparkSession.sparkContext.broadcast(_slice(items, n, n_slices)))
        out = part if out is None else out.unionByName(part)
    return out


def _slices(benchmark: DataFrame, item: str, item_text: str, slice_chars: int) -> tuple[DataFrame, int]:
    """The distinct items with their number of rows ``n``, and how many slices hold no more than twice ``slice_chars`` each.

    One item alone may be longer; it is never cut.
    """
    ship(benchmark.sparkSession)
    items = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    items = items.groupBy("item_id", "text").agg(F.count("*").cast("int").alias("n"))
    total, longest = items.agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    n_slices = max(1, -(-(total or 0) // slice_chars))
    while n_slices > 1:
        sizes = items.groupBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices))).agg(F.sum(F.length("text")).alias("size"))
        if sizes.agg(F.max("size")).first()[0] <= max(2 * slice_chars, longest):
            break
        n_slices *= 2
    return items, n_slices


def _slice(items: DataFrame, n: int, n_slices: int) -> list[tuple]:
    """A part of the items, dealt by a hash."""
    own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == n)
    return sorted((tuple(r) for r in own.collect()), key=str)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """The documents in which :func:`leaks` finds no benchmark item, with all their columns, without a shuffle.

    Each slice of the benchmark is a pass over what the slices before it have left.
    """
    items, n_slices = _slices(benchmark, item, item_text, slice_chars)

    def passed(df: DataFrame, held) -> DataFrame:
        name = uuid.uuid4().hex

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index_of(held.value, name)
            for batch in (part for whole in batches for part in slices(whole)):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in search(index, [t or "" for t in batch.column(text).to_pylist()])]] = False
                yield batch.filter(pa.array(keep))

        return df.mapInArrow(run, df.schema)

    for n in range(n_slices):
        docs = passed(docs, docs.sparkSession.sparkContext.broadcast(_slice(items, n, n_slices)))
    return docs
