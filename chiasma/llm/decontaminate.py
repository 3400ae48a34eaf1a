"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared lower-cased, with runs of white space as one space. An item of m characters may differ by
k = floor(RATE * m) edits (fewer where m is too short for the lemma to say anything). If a region of a text is within k
edits of the item, at least t = m + 1 - q * (k + 1) of the item's q-grams occur in it, on diagonals (text position less
item position) that span at most k. So:

1. The items' q-grams are hashed into a sorted table, with a bitmap before it. A text's rolling hashes are looked up; a
   hit gives (item, diagonal) for every place the q-gram has in the items, HITS at a time.
2. Hits are counted in diagonal bands of 2(k + 1) that overlap by half, so any span of k + 1 diagonals lies within one.
   Bands with t hits or more stay; neighbours of one item become one, up to WIDE diagonals, so a text of one repeated
   passage costs an alignment for each of those, not for each band.
3. The item is aligned with each band that stays, edits counted within the band widened by k on both sides, free at both
   ends of the text. Regions within k edits are leaks. Where only clean texts are kept, the first leak decides.

Documents are scanned where they are read: no shuffle, and nothing is sent but the items, in blocks of at most
BLOCK_CHARS characters with one pass each, so the broadcast is bounded for a benchmark of any size.

Defined results: null and empty items match nothing, nor do null and empty texts; items shorter than q match exactly;
of overlapping regions of one item in one text the one with the fewest edits counts; equal items report both ids;
repeated rows give repeated rows; an empty table on either side gives no leaks.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiasma.llm.common import documents, tidy

NAME = "op5_decontaminate"
Q, RATE = 10, 0.08
BLOCK_CHARS, CHUNK = 2 << 20, 1 << 20
#: Hits counted at a time; diagonals aligned at a time.
HITS, WIDE = 1 << 20, 1 << 16
_BITS = 22
_SPACES = [c for c in range(0x3001) if chr(c).isspace()]


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def positions(text: str):
    """For each character of normalised(text), where it stands in text; one more for the end."""
    import numpy as np

    low = [c.lower() for c in text] if len(text.lower()) != len(text) else text.lower()
    at = np.repeat(np.arange(len(text)), [len(c) for c in low]) if isinstance(low, list) else np.arange(len(text))
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    space = np.isin(cp, _SPACES)
    keep = np.flatnonzero(~(space & np.concatenate([[True], space[:-1]])))
    if len(keep) and space[keep[-1]]:
        keep = keep[:-1]
    return np.append(at[keep], at[keep[-1]] + 1) if len(keep) else np.zeros(1, int)


def _codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def qgram_hashes(code, q: int):
    """Hashes of all q-grams, doubled up from single characters."""
    import numpy as np

    base, h, n, out, done = np.uint64(0x9E3779B97F4A7C15), (code + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1, None, 0
    while True:
        if q & n:  # the q-gram is put together from runs of 1, 2, 4, ... characters
            length = len(code) - done - n + 1
            if length <= 0:
                return np.zeros(0, np.uint64)
            out = h[:length] if out is None else out[:length] * base ** np.uint64(n) + h[done : done + length]
            done += n
        n *= 2
        if n > q:
            break
        if len(h) <= n // 2:
            return np.zeros(0, np.uint64)
        h = h[: len(h) - n // 2] * base ** np.uint64(n // 2) + h[n // 2 :]
    return (out ^ (out >> np.uint64(31))) * base


class Items:
    """The q-gram table of some items."""

    def __init__(self, items: list[tuple], q: int = Q, rate: float = RATE):
        import numpy as np

        self.q = q
        self.ids, self.texts = [i for i, _ in items], [normalised(t) for _, t in items]
        m = [len(t) for t in self.texts]
        self.budget = [max(0, min(int(rate * n), n // q - 1)) for n in m]
        self.least = [n + 1 - q * (k + 1) for n, k in zip(m, self.budget, strict=True)]
        self.short = [k for k, n in enumerate(m) if 0 < n < q]
        hashes = [qgram_hashes(_codes(t), q) for t in self.texts]
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(m)), [len(x) for x in hashes])
        place = np.concatenate([*(np.arange(len(x)) for x in hashes), np.zeros(0, int)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.known, first = np.unique(h[order], return_index=True)
        self.first, self.n = first, np.diff(np.append(first, len(h)))
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.known >> np.uint64(64 - _BITS)] = True
        self.k = np.array(self.budget, np.int64)
        self.t = np.array(self.least, np.int64)

    def hits(self, text: str):
        """(item, diagonal) of every shared q-gram, in slices; long texts in chunks."""
        import numpy as np

        for lo in range(0, max(1, len(text) - self.q + 1), CHUNK):
            h = qgram_hashes(_codes(text[lo : lo + CHUNK + self.q - 1]), self.q)
            at = np.flatnonzero(self.bitmap[h >> np.uint64(64 - _BITS)])
            if not len(at):
                continue
            k = np.searchsorted(self.known, h[at])
            k[k == len(self.known)] = 0
            same = self.known[k] == h[at]
            at, k = at[same], k[same]
            n = self.n[k]
            end = np.cumsum(n)
            cuts = np.unique(np.concatenate([np.searchsorted(end, np.arange(HITS, end[-1], HITS), "left"), [0, len(at)]])) if len(at) else []
            for i, j in zip(cuts, cuts[1:], strict=False):  # a q-gram has no more places than the block has characters
                own = n[i:j]
                row = np.repeat(self.first[k[i:j]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                yield self.item[row], np.repeat(at[i:j] + lo, own) - self.place[row]

    def bands(self, text: str) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, diagonals) of the bands that meet the lemma's bound, neighbours as one."""
        import numpy as np

        if not len(self.known):
            return []
        key, count, bias = np.zeros(0, np.int64), np.zeros(0, np.int64), 1 << 39
        for item, d in self.hits(text):  # half a band each
            new, n = np.unique((item << 40) | (d // (self.k[item] + 1) + bias), return_counts=True)
            if len(key):
                new, at = np.unique(np.concatenate([key, new]), return_inverse=True)
                n = np.bincount(at, np.concatenate([count, n]), len(new)).astype(np.int64)
            key, count = new, n
        if not len(key):
            return []
        low = np.unique(np.concatenate([key, key - 1]))  # a band is this half and the next

        def of(k):
            at = np.searchsorted(key, k)
            at[at == len(key)] = 0
            return np.where(key[at] == k, count[at], 0)

        low = low[of(low) + of(low + 1) >= self.t[low >> 40]]
        if not len(low):
            return []
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        out = []
        for lo, hi in zip(low[first], low[np.append(first[1:], len(low)) - 1], strict=True):
            i = int(lo >> 40)
            width, step = self.budget[i] + 1, max(1, WIDE // (self.budget[i] + 1))
            for b in range(int(lo & ((1 << 40) - 1)) - bias, int(hi & ((1 << 40) - 1)) - bias + 1, step):
                last = min(b + step - 1, int(hi & ((1 << 40) - 1)) - bias)
                out.append((i, b * width, (last - b + 2) * width))
        return out

    def found(self, plain: str):
        """(item's index, start, end, edits) in a normalised text, lazily; regions of one item may overlap."""
        for i, low, wide in self.bands(plain):
            k, item = self.budget[i], self.texts[i]
            if wide + 3 * k < len(item):  # there is room for one region only
                lo, hi = max(0, low - k), low + wide + len(item) + k
                exact = plain.find(item, lo, hi)
                if exact >= 0:
                    yield i, exact, exact + len(item), 0
                    continue
            for start, end, edits in align(item, plain, low - k, wide + 2 * k, k, one=wide + 3 * k < len(item)):
                yield i, start, end, edits
        for i in self.short:
            at = plain.find(self.texts[i])
            while at >= 0:
                yield i, at, at + len(self.texts[i]), 0
                at = plain.find(self.texts[i], at + len(self.texts[i]))

    def any(self, text: str | None) -> bool:
        plain = normalised(text or "")
        return bool(plain) and next(iter(self.found(plain)), None) is not None

    def leaks(self, text: str | None) -> list[tuple]:
        """(item's index, start, end, edits) in the text as it was given."""
        from bisect import bisect_left, insort

        plain = normalised(text or "")
        if not plain:
            return []
        kept, taken = [], {}
        for x in sorted(set(self.found(plain)), key=lambda x: (x[0], x[3], x[1], x[2])):
            own = taken.setdefault(x[0], [])  # regions of the item, none of which overlap
            k = bisect_left(own, (x[1], x[2]))
            if (k and own[k - 1][1] > x[1]) or (k < len(own) and own[k][0] < x[2]):
                continue
            insort(own, (x[1], x[2]))
            kept.append(x)
        if not kept:
            return []
        at = positions(text)
        return [(i, int(at[a]), int(at[b - 1]) + 1, e) for i, a, b, e in kept]


def align(item: str, text: str, low: int, width: int, most: int, one: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the region of text nearest to item within the diagonals low to low + width, or of the best
    one at every end; none that takes more than `most` edits."""
    import numpy as np

    a, m, reach = _codes(item), len(item), np.arange(width + 1)
    b = np.full(m + width + 1, 0xFFFFFFFF, np.uint64)  # text[low : low + m + width], with no character outside the text
    own = _codes(text[max(0, low) : max(0, low + m + width)])
    b[max(0, -low) : max(0, -low) + len(own)] = own
    big = np.int64(1 << 30)
    inside = (low + reach >= 0) & (low + reach <= len(text))
    cost, start = np.where(inside, 0, big), low + reach  # row 0: the text may begin anywhere
    for i in range(m):
        sub = cost + (b[i : i + width + 1] != a[i])
        gone = np.append(cost[1:] + 1, big)  # the item's character is missing
        took = gone < sub
        best, begin = np.where(took, gone, sub), np.where(took, np.append(start[1:], 0), start)
        x = best - reach  # further characters of the text cost one each
        low_x = np.minimum.accumulate(x)
        source = np.maximum.accumulate(np.where(x == low_x, reach, 0))
        cost, start = low_x + reach, begin[source]
        if cost.min() > most:
            return []
    end = low + m + reach
    cost = np.where((end >= 0) & (end <= len(text)), cost, big)
    at = [int(np.argmin(cost))] if one else np.flatnonzero(cost <= most).tolist()
    return [(max(0, int(start[k])), int(end[k]), int(cost[k])) for k in at if cost[k] <= most]


@functools.lru_cache(maxsize=2)
def _items(broadcast_id: str, holder) -> Items:
    """One table for each block and Python worker."""
    return Items(holder.value)


class _Block:
    """A broadcast block of items that caches by its id."""

    def __init__(self, key: str, sent):
        self.key, self.sent = key, sent

    @property
    def value(self):
        return self.sent.value

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key


def _blocks(bench: DataFrame, id_col: str, text_col: str) -> list[_Block]:
    import uuid

    b = bench.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    total = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    out = []
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("id", "text").collect()  # about BLOCK_CHARS
        out.append(_Block(uuid.uuid4().hex, bench.sparkSession.sparkContext.broadcast([(r.id, r.text) for r in rows])))
    return out


def _report(block: _Block):
    def run(batches):
        import pyarrow as pa

        items = _items(block.key, block)
        for b in batches:
            out = [(doc.as_py(), items.ids[i], start, end, edits, items.budget[i]) for doc, text in zip(b.column(0), b.column(1), strict=True) for i, start, end, edits in items.leaks(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()])], ["doc", "item", "start", "end", "edits", "budget"])

    return run


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id_col, item_col, start, end (characters of the text), edits, budget of every region of a text that leaks an item."""
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    schema = "doc long, item long, start long, end long, edits int, budget int"
    out = docs.sparkSession.createDataFrame([], schema)
    for k, block in enumerate(_blocks(bench, item_col, item_text_col)):
        found = d.mapInArrow(tidy(_report(block)), schema)
        out = found if k == 0 else out.unionByName(found)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "start", "end", "edits", "budget")


def _clean(block: _Block, text_col: str):
    def run(batches):
        import pyarrow as pa

        items = _items(block.key, block)
        for b in batches:
            yield b.filter(pa.array([not items.any(t.as_py()) for t in b.column(text_col)], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with its columns, whose text leaks no item."""
    for block in _blocks(bench, item_col, item_text_col):
        docs = docs.mapInArrow(tidy(_clean(block, text_col)), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
