"""Benchmark decontamination by the q-gram lemma.

A text region within edit distance k of an item of length L shares at least
``L - q + 1 - q * k`` of the item's q-grams, and they lie on diagonals (place in the document
less place in the item) at most k apart.  Each document's q-grams are looked up in the items'
index, matches are counted in diagonal bands that overlap by the largest k, bands that meet the
bound are regions, and a banded alignment of the item in the region gives the distance.  Items
too short for a q-gram are compared, whole and exactly, with every place between word bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

Q = 8
#: The edit budget is this part of an item's length, rounded down, and less where the lemma's bound would fall under 1.
EDIT_RATE = 0.10
#: Diagonals of a band, or more where an item's budget asks for it.
BAND = 64
#: Bytes of benchmark text that are searched for at once; more items make more passes over the documents.
BLOCK_BYTES = 4 << 20
#: Matches of q-grams that are held at once.
POSTINGS = 1_000_000
_FILTER_BITS = 20
#: True for ASCII letters and digits and for the bytes of all other characters.
_WORD = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


def normalise(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z in lower case and each run of white space as one space, none at a document's ends."""
    space = textkit.SPACE[data]
    keep = np.ones(len(data) + 1, bool)
    keep[1 : len(data)] = ~(space[1:] & space[:-1])
    some = offs[:-1][np.diff(offs) > 0]
    keep[some] = ~space[some]
    keep = keep[: len(data)]
    low = textkit.LOWER[data]
    low[space] = 0x20
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return low[keep], total[offs]


def qgram_codes(data: np.ndarray) -> np.ndarray:
    """A 64-bit code of each q-gram."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(data)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    return textkit.mix(eight[:n] * np.uint64(0x9E3779B97F4A7C15) + eight[Q - 8 : Q - 8 + n])


def gram_codes(data: np.ndarray, length: int) -> np.ndarray:
    """The bytes of each run of ``length`` < 8 successive bytes as one number."""
    n = max(0, len(data) - length + 1)
    code = np.zeros(n, np.uint64)
    for k in range(length):
        code = code << np.uint64(8) | data[k : k + n].astype(np.uint64)
    return code


def banded_distance(item: np.ndarray, region: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int]:
    """Least edit distance of ``item`` to a part of ``region`` on the diagonals low..high, and that part's end.

    The distance is budget + 1 if it exceeds the budget.
    """
    low, high = low - budget, high + budget
    width = high - low + 1
    big = 1 << 20
    step = np.arange(width)
    at = low + step  # region place before which column k of the current row ends
    row = np.where((at >= 0) & (at <= len(region)), 0, big)
    padded = np.full(width + len(item) + 1, -1, np.int64)
    a, b = max(0, low), min(len(region), low + len(padded))
    if b > a:
        padded[a - low : b - low] = region[a:b]
    for i in range(len(item)):
        # column k of row i + 1 ends at region place low + k + i + 1
        change = row + (padded[i : i + width] != item[i])
        drop = np.append(row[1:], big) + 1
        row = np.minimum(change, drop)
        at = low + step + i + 1
        row = np.where((at >= 0) & (at <= len(region)), row, big)
        row = np.minimum.accumulate(row - step) + step
        if row.min() > budget:
            return budget + 1, 0
    best = int(row.argmin())
    return int(row[best]), low + best + len(item)


class ItemIndex:
    """The q-grams of a block of items."""

    def __init__(self, ids: list, texts: list[str]):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offs = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
        data, offs = normalise(data, offs)
        items = [data[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        items = [x[: len(x) - (len(x) > 0 and x[-1] == 0x20)] for x in items]
        chosen = [k for k, x in enumerate(items) if len(x) >= Q]
        short = [k for k, x in enumerate(items) if 0 < len(x) < Q]
        self.ids, self.items = [ids[k] for k in chosen + short], [items[k] for k in chosen]
        #: For each length under Q the codes of the short items, in order, and their places in ``ids``.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({len(items[k]) for k in short}):
            own = [(int(gram_codes(items[k], length)[0]), len(chosen) + at) for at, k in enumerate(short) if len(items[k]) == length]
            self.short[length] = np.array([c for c, _ in sorted(own)], np.uint64), np.array([at for _, at in sorted(own)], np.int64)
        size = np.array([len(x) for x in self.items], np.int64)
        self.budget = np.maximum(0, np.minimum((size * EDIT_RATE).astype(np.int64), (size - Q) // Q))
        self.bound = size - Q + 1 - Q * self.budget
        self.widest = int(self.budget.max()) if len(size) else 0
        self.band = max(BAND, self.widest + 1)
        codes = [qgram_codes(x) for x in self.items]
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else item
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.first = np.unique(code[order], return_index=True)
        self.first = np.r_[self.first, len(code)]
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.codes >> np.uint64(64 - _FILTER_BITS)] = True

    def search(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, begin, end) of the best region of each item in each document."""
        return sorted(self.search_long(data, offs) + self.search_short(data, offs))

    def search_short(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The first place of each item under Q bytes in each document where no word goes on at either end of it."""
        out = []
        word = _WORD[data]
        cut = np.ones(len(data) + 1, bool)  # a word doesn't go on from the byte before to this one
        cut[1 : len(data)] = ~(word[1:] & word[:-1])
        cut[offs] = True
        for length, (known, which) in self.short.items():
            places = np.flatnonzero(cut[: max(0, len(data) - length + 1)] & cut[length:])
            codes = gram_codes(data, length)[places]
            low, high = np.searchsorted(known, codes, "left"), np.searchsorted(known, codes, "right")
            some = np.flatnonzero(high > low)
            doc = np.searchsorted(offs, places[some], "right") - 1
            some, doc = (x[places[some] + length <= offs[doc + 1]] for x in (some, doc))
            times = high[some] - low[some]
            item, doc, begin = which[textkit.ranges(low[some], times)], np.repeat(doc, times), np.repeat(places[some], times)
            _, first = np.unique(doc * len(self.ids) + item, return_index=True)
            begin = begin[first] - offs[doc[first]]
            out += zip(doc[first].tolist(), item[first].tolist(), [0] * len(first), begin.tolist(), (begin + length).tolist(), strict=True)
        return out

    def search_long(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The same for the items of Q bytes and more."""
        codes = qgram_codes(data)
        hit = np.flatnonzero(self.seen[codes >> np.uint64(64 - _FILTER_BITS)])
        if not len(hit) or not len(self.codes):
            return []
        at = np.minimum(np.searchsorted(self.codes, codes[hit]), len(self.codes) - 1)
        right = self.codes[at] == codes[hit]
        hit, at = hit[right], at[right]
        doc = np.searchsorted(offs, hit, "right") - 1
        whole = hit + Q <= offs[doc + 1]
        hit, at, doc = hit[whole], at[whole], doc[whole]
        pair, band, count = self.count_bands(hit, at, doc, offs)
        met = count >= self.bound[pair % len(self.items)]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for own, b in zip(pair[met].tolist(), band[met].tolist(), strict=True):
            d, k = divmod(own, len(self.items))
            if (d, k) in best and best[d, k][0] == 0:
                continue  # bands go upwards: what follows is no earlier
            low = b * self.band - (1 << 20)
            found = self.align(k, data[offs[d] : offs[d + 1]], low, low + self.band + self.widest - 1)
            if found and ((d, k) not in best or found < best[d, k]):
                best[d, k] = found
        return [(d, k, *v) for (d, k), v in sorted(best.items())]

    def count_bands(self, hit: np.ndarray, at: np.ndarray, doc: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document and item as one number, band, shared q-grams), in order.

        A q-gram that both sides repeat has as many matches as the product of its places, so the
        matches are made and counted POSTINGS at a time.
        """
        times = self.first[at + 1] - self.first[at]
        bound = np.cumsum(times)
        # one number for both: bands of texts up to 2 GB fit 25 bits, documents of a slice times items of a block the rest
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        a = 0
        while a < len(hit):
            e = max(a + 1, int(np.searchsorted(bound, (bound[a - 1] if a else 0) + POSTINGS, "right")))
            posting = textkit.ranges(self.first[at[a:e]], times[a:e])
            own = np.repeat(doc[a:e], times[a:e])
            pair = own * len(self.items) + self.item[posting]
            diagonal = np.repeat(hit[a:e], times[a:e]) - self.place[posting] - offs[own] + (1 << 20)
            band = diagonal // self.band
            lower = diagonal % self.band < self.widest  # also in the band before, which reaches over
            new, n = np.unique(np.r_[pair << 25 | band, (pair << 25 | band - 1)[lower]], return_counts=True)
            both = np.r_[keys, new]
            keys, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, np.r_[counts, n], len(keys)).astype(np.int64)
            a = e
        return keys >> 25, keys & ((1 << 25) - 1), counts

    def align(self, k: int, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
        """(distance, begin, end) of item k on these diagonals, or None beyond its budget."""
        item, budget = self.items[k], int(self.budget[k])
        begin = max(0, low - budget)
        region = text[begin : max(begin, high + len(item) + budget)]
        exact = region.tobytes().find(item.tobytes())
        if exact >= 0:
            return 0, begin + exact, begin + exact + len(item)
        distance, end = banded_distance(item, region, low - begin, high - begin, budget)
        if distance > budget:
            return None
        back = region[:end][::-1]
        _, length = banded_distance(item[::-1], back, 0, 0, budget)
        return distance, begin + end - length, begin + end


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, distance, begin, stop): each document and item that has a region within the item's edit budget.

    begin and stop count bytes of the normalised text (see ``normalise``) and mark the region of
    least distance, the first of equals.  An item under Q bytes must stand there exactly and between
    word bounds.  Null texts and items match nothing, nor do items of white space only.  Repeated
    rows are searched each.  No row is shuffled; the items of a pass are
    broadcast, BLOCK_BYTES of text at most on the average.
    """
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text")).where("_text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // BLOCK_BYTES))
    types, out = dict(docs.dtypes), None
    schema = f"`{id_col}` {types[id_col]}, `{item_col}` {dict(benchmark.dtypes)[item_col]}, distance int, begin long, stop long"
    arrow = {name: None for name in (id_col, item_col)}
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block).orderBy("_item", "_text").collect()
        ids, texts = [r._item for r in rows], [r._text for r in rows]

        def kernel(batches: Iterator[pa.RecordBatch], ids: list = ids, texts: list[str] = texts) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(ids, texts)
            for part, offs, data in textkit.slices(batches, text_col):
                data, offs = normalise(data, offs)
                found = index.search(data, offs)
                if found:
                    d, k, distance, begin, stop = (list(x) for x in zip(*found, strict=True))
                    own = part.column(part.schema.get_field_index(id_col)).take(pa.array(d))
                    yield pa.RecordBatch.from_arrays([own, pa.array([index.ids[x] for x in k]), pa.array(distance, pa.int32()), pa.array(begin, pa.int64()), pa.array(stop, pa.int64())], [*arrow, "distance", "begin", "stop"])

        found = docs.select(id_col, text_col).mapInArrow(kernel, schema)
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates; rows with a null id stay."""
    # the anti join has the id alone on its other side, so no column of ``docs`` can clash
    return docs.join(contaminated(docs, benchmark, id_col, text_col).select(id_col).distinct(), id_col, "left_anti")
