"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprint. A-Z are lower-cased, words are runs of [^\\x20\\x09-\\x0D], shingles are `words` words joined by spaces
(repeats included; a shorter text is one shingle; no words: fingerprint zero). A bit is 1 if it is set in over half of
the shingles' XXH64 (UTF-8, seed 42). keep_one counts each distinct shingle once, as its similarity is one of sets, and
takes a second view of the same shingles, which mixes each hash anew.

Search. Work is on distinct fingerprints, so copies cost nothing further. The 64 bits are cut into blocks; two
fingerprints within `distance` bits agree on some choice of (blocks - distance) blocks, and each choice is a table: rows
meet where they share its masked bit pattern, the top node of an index over them. The rows under one pattern are sorted by
Gray rank, so neighbours share long bit patterns. Up to sixteen neighbours make a node (the bits on which all agree),
sixteen nodes the next, and so on up to the pattern; every run of two rows or more has such an index, and all links come
from it. Pairs of nodes are opened from the top: the differences on the bits that both share add to those found above,
whole groups are pruned when the sum passes `distance`, and groups that cannot differ by more are linked without looking
inside. What is given are spanning forests, so a dense group never emits its pairs; an edge is given by the first table
where its ends meet only. With two views, a pair that is within `distance` in one must be within `far` in the other, which
random pairs are not, so that candidates don't grow together as a corpus grows. keep_one's rows meet not under bit patterns,
whose runs grow with the corpus, but under the keys of BANDS bands: the smallest of the `words`-word shingles' hashes in BAND
orders. Rows at similarity s share a key with a chance of 1 - (1 - s^BAND)^BANDS, at 0.8 all but 0.00001 of them; different
texts share none.

Verification (keep_one). What links by SimHash is only a candidate; its similarity is taken from bottom-SKETCH sketches of
the distinct shingle hashes, which are the whole sets, and exact, for texts of fewer than SKETCH distinct shingles, and
else have a standard error below 0.021. Forests prefer near pairs and are made at three distances, so most groups hold
together by verified edges alone. Where they do not, the pieces into which a component of candidates falls are compared
pair by pair, blocks of strays against blocks of the component, so no near and similar pair is left out.

Components. Alternating large-star and small-star steps over written edge tables; only counts reach the driver.

Defined results: null and empty texts have fingerprint zero and link like any other; a component's id is its smallest
id that is not null (null if none); repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiasma.llm.common import documents, dropped, tidy, written

NAME = "op7_simhash"
#: Children of a node of the index, and rows of its lowest nodes.
LEAF = 16
#: Rows that are indexed together, as far as their last run allows.
ROWS = 1 << 17
#: Hashes of a sketch.
SKETCH = 384
#: Rows that may be expected under one pattern before tables of longer patterns are taken.
CROWDED = 4000
#: Pairs of children looked at at a time.
OPEN = 1 << 20
#: Bands of that many smallest hashes each, in which keep_one seeks its candidates.
BANDS, BAND = 16, 3
#: Bytes of the texts whose shingles are hashed together.
SLICE_BYTES = 8 << 20
#: Rows a side of a block in which the pieces of a candidate component are compared.
BLOCK = 512


def masks(distance: int, rows: int = 0) -> list[int]:
    """Bit masks of the tables: any two 64-bit values within the distance agree on at least one of them. The more rows,
    the longer the patterns."""
    equal = 1 if distance <= 3 else 2
    while equal < 5 and rows >> (64 * equal // (distance + equal)) > CROWDED:
        equal += 1
    blocks = distance + equal
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, equal)]


def _majority(h):
    """The bits that over half of the hashes have, counted in slices of bounded memory."""
    import numpy as np

    n = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        n += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(n * 2 > len(h), bitorder="little").view(np.int64)[0]


def _fingerprints(words: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for b in batches:
            out = []
            for text in b.column(1):
                w = (text.as_py() or "").encode().lower().split()  # bytes: only ASCII letters and white space count
                parts = [w[k:] for k in range(words)]
                shingles = map(b" ".join, zip(*parts, strict=False)) if len(w) >= words else [b" ".join(w)]
                out.append(_majority(np.array([xxh64_intdigest(s, 42) for s in shingles], np.uint64)) if w else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["id", "fp0"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp0, the fingerprint, of every row."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return d.mapInArrow(tidy(_fingerprints(words)), "id long, fp0 long")


def grams(h, n: int):
    """The distinct hashes of all runs of n word hashes, ascending; of all of them where there are fewer."""
    import numpy as np

    n, odd = min(n, len(h)), np.uint64(0x9E3779B97F4A7C15)
    x = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        x = (x ^ (x >> np.uint64(29))) * odd + h[k : len(h) - n + 1 + k]
    x ^= x >> np.uint64(32)
    return np.unique(x * odd)


def _words(texts):
    """The words of a string array in a row, as hashes, and how many each text has. Each distinct word is hashed once."""
    import numpy as np
    import pyarrow.compute as pc
    from xxhash import xxh64_intdigest

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, at = lists.flatten(), lists.offsets.to_numpy()
    some = pc.not_equal(pc.binary_length(flat), 0)  # white space at an end leaves an empty string
    n = np.diff(np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[at - at[0]])
    coded = flat.filter(some).dictionary_encode()
    own = coded.dictionary
    raw, ends = (own.buffers()[2] or b"") and own.buffers()[2].to_pybytes(), np.frombuffer(own.buffers()[1], "<i4", len(own) + 1, 4 * own.offset).tolist() if len(own) else [0]
    h = np.fromiter((xxh64_intdigest(raw[a:z], 42) for a, z in zip(ends, ends[1:], strict=False)), np.uint64, len(own))
    return h[coded.indices.to_numpy()], n


def _all_grams(h, n, size: int):
    """grams() of many texts: all in a row, and how many each has. h: the word hashes of all, n: how many each has."""
    import numpy as np

    odd, ends = np.uint64(0x9E3779B97F4A7C15), np.cumsum(n)
    x, room = np.zeros(max(0, len(h) - size + 1), np.uint64), np.maximum(n - size + 1, 0)
    for k in range(size if len(x) else 0):
        x = (x ^ (x >> np.uint64(29))) * odd + h[k : len(h) - size + 1 + k]
    x ^= x >> np.uint64(32)
    x = x * odd
    short = np.flatnonzero((n > 0) & (n < size))
    whole = np.concatenate([grams(h[ends[k] - n[k] : ends[k]], size) for k in short]) if len(short) else np.zeros(0, np.uint64)
    room[short] = 1
    to = np.cumsum(room)
    out, begin = np.empty(int(to[-1]) if len(to) else 0, np.uint64), to - room
    long = np.flatnonzero(n >= size)
    for a, z, b in zip(begin[long].tolist(), to[long].tolist(), (ends - n)[long].tolist(), strict=True):
        own = out[a:z]
        own[:] = x[b : b + z - a]
        own.sort()
    out[begin[short]] = whole
    first = np.concatenate([[True], out[1:] != out[:-1]])[: len(out)]
    first[begin[room > 0]] = True
    return out[first], np.diff(np.concatenate([[0], np.cumsum(first)])[np.append(0, to)])


def _majorities(h, n):
    """_majority() of many texts, of whose hashes h each has n. Eight sums of a byte each are added up at a time."""
    import numpy as np

    some = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if not len(some):
        return out.view(np.int64)
    pieces = -(-n[some] // 255)  # no sum of a byte overflows
    up = np.cumsum(pieces) - pieces
    which, k = _ranges(np.zeros(len(some), np.int64), pieces)
    begin = (np.cumsum(n) - n)[some][which] + 255 * k
    total = np.zeros((len(some), 64), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), begin)
        total[:, bit::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), up, axis=0, dtype=np.int64)
    out[some] = np.packbits(total * 2 > n[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out.view(np.int64)


def _band_keys(h, n):
    """A key for each band and text, of whose distinct hashes h each has n: BAND smallest hashes, each in an order of its own."""
    import numpy as np

    some, odd = np.flatnonzero(n), np.uint64(0x9E3779B97F4A7C15)
    keys = np.zeros((len(n), BANDS), np.uint64)
    at, low = (np.cumsum(n) - n)[some], (h >> np.uint64(32)).astype(np.uint32)
    factor = np.random.default_rng(20240229).integers(0, 1 << 31, BANDS * BAND, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    for k, f in enumerate(factor):
        if len(some):
            least = np.minimum.reduceat(low * f, at).astype(np.uint64)
            x = keys[some, k // BAND]
            keys[some, k // BAND] = (x ^ (x >> np.uint64(29))) * odd + least
    keys = (keys ^ (keys >> np.uint64(32))) * odd + np.arange(BANDS, dtype=np.uint64)  # keys of two bands differ
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def _near_prints(words: int, print_words: int, views: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64)
            cuts = np.unique(np.concatenate([np.flatnonzero(np.diff((np.cumsum(size) - size) // SLICE_BYTES)) + 1, [0, len(b)]])).tolist()
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                word, n = _words(b.column(1)[lo:hi])
                h, m = _all_grams(word, n, words)
                short = (h >> np.uint64(32)).astype("<u4").tobytes()
                begin = np.cumsum(m) - m
                sketches = [short[4 * i : 4 * (i + j)] for i, j in zip(begin.tolist(), np.minimum(m, SKETCH).tolist(), strict=True)]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (len(n) + 1), BANDS, dtype=np.int32)), pa.array(_band_keys(h, m).ravel()))
                h, m = _all_grams(word, n, print_words)
                out = []
                for _ in range(views):
                    out.append(_majorities(h, m))
                    h = h * odd
                    h ^= h >> np.uint64(29)
                    h *= odd
                    h ^= h >> np.uint64(32)
                columns = [b.column(0)[lo:hi], b.column(2)[lo:hi], *map(pa.array, out), pa.array(sketches, pa.binary()), bands]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h", *(f"fp{k}" for k in range(views)), "sketch", "bands"])

    return run


def near_prints(docs: DataFrame, words: int, print_words: int, views: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h (a hash of the whole row), fp0, fp1, ... of the distinct shingles of print_words words, and a sketch and the bands'
    keys of those of `words` words, of every row."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h"))
    return d.mapInArrow(tidy(_near_prints(words, print_words, views)), "id long, h long, " + ", ".join(f"fp{k} long" for k in range(views)) + ", sketch binary, bands array<long>")


def gray_rank(c):
    """The rank of a 64-bit pattern in Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, k))
    return c


def _tree(x, bounds):
    """The index over runs of Gray-ordered fingerprints: for each level (p, m, lo, hi, bounds) with each node's shared bits,
    the mask of those, its children in the level below (rows, at the lowest) and where each run's nodes begin. Up to LEAF
    neighbours of a run make a node, and so on until every run has one: its pattern is what all its rows share."""
    import numpy as np

    n = len(x)
    levels = [(x, np.full(n, ~np.uint64(0)), None, None, bounds)]
    while len(levels) == 1 or (np.diff(bounds) > 1).any():
        p, m = levels[-1][:2]
        groups = -(-np.diff(bounds) // LEAF)
        above = np.concatenate([[0], np.cumsum(groups)])
        run = np.repeat(np.arange(len(groups)), groups)
        lo = bounds[run] + (np.arange(above[-1]) - above[run]) * LEAF
        hi = np.minimum(lo + LEAF, bounds[run + 1])
        both, some, shared = np.bitwise_and.reduceat(p, lo), np.bitwise_or.reduceat(p, lo), np.bitwise_and.reduceat(m, lo)
        shared &= ~(both ^ some)
        levels.append((both & shared, shared, lo, hi, above))
        bounds = above
    return levels


def _ranges(lo, hi):
    """(which range, number) of every number in the ranges."""
    import numpy as np

    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def search(x, distance: int, bounds=None, more=()):
    """Edges (i, j) of a spanning forest of all pairs of x that are within the distance, and in `more`, pairs of (other
    fingerprints of the rows, distance), too. x: runs of rows in Gray order, which begin at `bounds`; pairs are sought within
    a run. Node pairs are opened from each run's top: the differences on the bits that both nodes share are added to those
    on the bits shared above, and a pair of nodes is left when they exceed the distance, or when all its rows are one
    component already. Where they cannot differ by more, all rows are joined without looking inside."""
    import numpy as np

    n = len(x)
    bounds = np.array([0, n]) if bounds is None else bounds
    if n < 2:
        return []
    levels = _tree(x, bounds)
    rows = [None]  # rows of each node: from, to
    for k, (_, _, lo, hi, _) in enumerate(levels[1:]):
        rows.append((lo, hi) if k == 0 else (rows[k][0][lo], rows[k][1][hi - 1]))
    label, edges, seen = np.arange(n), [], {}

    def join(i, j):
        """Adds pairs of rows to the forest."""
        for other, most in more:
            near = np.bitwise_count(other[i] ^ other[j]) <= most
            i, j = i[near], j[near]
        while len(i):
            a, b = label[i], label[j]
            i, j, a, b = (v[a != b] for v in (i, j, a, b))
            if not len(i):
                return
            seen.clear()
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((lo, np.bitwise_count(x[i] ^ x[j]), hi))  # the nearest first
            first = order[np.flatnonzero(np.diff(hi[order], prepend=-1))]  # each root takes one smaller root: no cycles
            edges.append((i[first], j[first]))
            root = np.unique(hi[first])  # of these alone the labels change
            to = lo[first]  # hi[first] ascends, as order does
            while len(up := np.flatnonzero(np.isin(to, root))):
                to = to.copy()
                to[up] = to[np.searchsorted(root, to[up])]
            at = np.searchsorted(root, label)
            at[at == len(root)] = 0
            changed = root[at] == label
            label[changed] = to[at[changed]]

    def one(level):
        """For each node of the level, the label that all its rows have, else -1."""
        if level not in seen:
            at = rows[level][0]
            lo, hi = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            seen[level] = np.where(lo == hi, lo, -1)
        return seen[level]

    top = len(levels) - 1
    i = np.flatnonzero(rows[top][1] - rows[top][0] > 1)
    stack = [(top, i, i, np.zeros(len(i), np.int64), levels[top][1][i])]
    while stack:
        level, i, j, acc, known = stack.pop()
        own = one(level)
        keep = (own[i] != own[j]) | (own[i] < 0)
        i, j, acc, known = i[keep], j[keep], acc[keep], known[keep]
        if not len(i):
            continue
        _, _, lo, hi, _ = levels[level]
        count = (hi[i] - lo[i]) * (hi[j] - lo[j])
        fit = max(1, int(np.searchsorted(np.cumsum(count), OPEN, "right")))
        if fit < len(i):
            stack.append((level, i[fit:], j[fit:], acc[fit:], known[fit:]))
            i, j, acc, known, count = i[:fit], j[:fit], acc[:fit], known[:fit], count[:fit]
        at = np.repeat(np.arange(len(i)), count)
        k = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        wide = (hi[j] - lo[j])[at]
        ci, cj = lo[i][at] + k // wide, lo[j][at] + k % wide
        keep = (ci < cj) | (ci == cj) & (level > 1)
        ci, cj, at = ci[keep], cj[keep], at[keep]
        p, m = levels[level - 1][:2]
        shared = m[ci] & m[cj]
        acc = acc[at] + np.bitwise_count((p[ci] ^ p[cj]) & shared & ~known[at])  # only the bits that the nodes above did not share
        keep = acc <= distance
        ci, cj, acc, shared = ci[keep], cj[keep], acc[keep], shared[keep]
        if level == 1:
            join(ci, cj)
            continue
        if not more:  # all rows of both nodes are within the distance
            sure = acc + 64 - np.bitwise_count(shared) <= distance
            if sure.any():
                a, z = rows[level - 1]
                for to in (ci[sure], cj[sure]):
                    which, row = _ranges(a[to], z[to])
                    first = a[ci[sure]][which]
                    join(first[first != row], row[first != row])
                ci, cj, acc, shared = ci[~sure], cj[~sure], acc[~sure], shared[~sure]
        stack.append((level - 1, ci, cj, acc, shared))
    return edges


def _edges(distance: int, tables: list[int], forests: tuple, views: int, far: int):
    """From rows (table, key, node, fp, other views) in (table, key, Gray) order: pairs of nodes whose fingerprints are near."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        mask = np.array(tables, np.uint64)

        def found(table, key, node, x, *others):
            x, others = x.view(np.uint64), [(o.view(np.uint64), far) for o in others]
            bounds = np.flatnonzero(np.concatenate([[True], (table[1:] != table[:-1]) | (key[1:] != key[:-1]), [True]]))
            some = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
            bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[np.diff(bounds) > 1])])
            table, node, x, others = table[some], node[some], x[some], [(o[some], d) for o, d in others]
            out = [np.stack([i, j]) for f in forests for i, j in search(x, f, bounds, others)]
            i, j = np.concatenate(out, axis=1) if out else (np.zeros(0, int), np.zeros(0, int))
            # Only pairs that meet in no earlier table. The forests keep their components: the ends of an edge left out are
            # joined in the earlier table's run, by edges of which the same holds.
            for t in range(int(table[i].max()) if len(i) else 0):
                new = (table[i] <= t) | (((x[i] ^ x[j]) & mask[t]) != 0)
                i, j = i[new], j[new]
            return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

        held: list[list] = []  # columns of the batches since the last that ended a run
        size = 0
        for b in batches:
            if not len(b):
                continue
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            done = last[-1] + 1 if len(last) else 0
            if not done and held and (held[-1][0][-1] != now[0][0] or held[-1][1][-1] != now[1][0]):
                yield found(*(np.concatenate(v) for v in zip(*held, strict=True)))
                held, size = [], 0
            if done and size + done >= ROWS:  # all but the last run are whole
                held.append([v[:done] for v in now])
                yield found(*(np.concatenate(v) for v in zip(*held, strict=True)))
                held, size, now = [], 0, [v[done:].copy() for v in now]
            held.append(now)
            size += len(now[0])
        if held:
            yield found(*(np.concatenate(v) for v in zip(*held, strict=True)))

    return run


def _gray_order(run, x):
    """The order by run and the rank of x in Gray order."""
    import numpy as np

    g = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        g ^= g >> np.uint64(k)
    return np.lexsort((g, run))


def _edges_in_bands(forests: tuple, views: int, far: int):
    """From rows (key, node, fp0, fp1, ...) in the order of the keys: pairs of nodes with one key whose fingerprints are near."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def found(held):
            key, node, *fps = (np.concatenate(v) for v in zip(*held, strict=True))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            n = np.diff(starts)
            some, bounds = np.repeat(n > 1, n), np.concatenate([[0], np.cumsum(n[n > 1])])
            node, fps = node[some], [x[some].view(np.uint64) for x in fps]
            which, out = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), [np.zeros((2, 0), np.int64)]
            for v, x in enumerate(fps):
                order = _gray_order(which, x)
                others = [(y[order], far) for k, y in enumerate(fps) if k != v]
                out += [node[order[np.stack([i, j])]] for f in forests for i, j in search(x[order], f, bounds, others)]
            pairs = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        held, size = [], 0  # columns of the batches since the last that ended a run
        for b in batches:
            if not len(b):
                continue
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
            if size >= ROWS:
                done = int(np.searchsorted(now[0] != held[-1][0][-1], True))  # the last run may go on
                held.append([v[:done] for v in now])
                size, now = size + done, [v[done:] for v in now]
                if not len(now[0]):
                    continue
                yield found(held)
                held, size = [], 0
            held.append(now)
            size += len(now[0])
        if held:
            yield found(held)

    return run


def links(nodes: DataFrame, distance: int, forests: tuple | None = None, far: int = 64) -> DataFrame:
    """Edges a, b between rows of nodes (node, fp0, fp1, ...) of which one view is within the distance and the others are
    within `far`: those of spanning forests at each distance of `forests`. With a column `bands`, rows meet where they
    share a band's key instead of a bit pattern, in all views at once."""
    if "bands" in nodes.columns:
        views = [c for c in nodes.columns if c.startswith("fp")]
        rows = nodes.select(F.explode("bands").alias("key"), "node", *views).repartition("key").sortWithinPartitions("key")
        return rows.mapInArrow(tidy(_edges_in_bands(forests or (distance,), len(views), far)), "a long, b long")
    tables = masks(distance, nodes.count())
    views, out = [c for c in nodes.columns if c.startswith("fp")], None
    for v in views:
        others = [c for c in views if c != v]
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("table"), F.col(v).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for k, m in enumerate(tables)]))
        rows = nodes.select("node", F.col(v).alias("fp"), *(F.col(c).alias(f"other{k}") for k, c in enumerate(others)), each.alias("t"))
        rows = rows.select("t.table", "t.key", "node", "fp", *(f"other{k}" for k in range(len(others))))
        rows = rows.repartition("table", "key").sortWithinPartitions("table", "key", gray_rank(F.col("fp")))
        e = rows.mapInArrow(tidy(_edges(distance, tables, forests or (distance,), len(views), far)), "a long, b long")
        out = e if out is None else out.unionByName(e)
    return out


def alike(x, y, least: float) -> bool:
    """Whether two sketches (sorted arrays) are as similar as that."""
    import numpy as np

    both = np.union1d(x, y)
    if max(len(x), len(y)) >= SKETCH:
        both = both[:SKETCH]  # the smallest of the union are in one sketch or the other
    common = np.isin(both, x, assume_unique=True) & np.isin(both, y, assume_unique=True)
    return not len(both) or common.sum() >= least * len(both)


class _Sketches:
    """Sketches of the rows of a block, compared by column."""

    def __init__(self, sketches: list):
        import numpy as np

        self.n = np.array([len(x) for x in sketches], np.int64)
        self.end = np.cumsum(self.n)
        known, self.code = np.unique(np.concatenate([*sketches, np.zeros(0, "<u4")]), return_inverse=True)
        self.mark = np.zeros(len(known), np.int32)

    def alike(self, i: int, others, least: float):
        """What alike() says of row i and each of the others."""
        import numpy as np

        n, own = self.n[others], self.code[self.end[i] - self.n[i] : self.end[i]]
        self.mark[own] = 1
        upto = np.cumsum(self.mark)  # hashes of i up to each
        which, at = _ranges(self.end[others] - n, self.end[others])
        code = self.code[at]
        common = self.mark[code].astype(np.int64)
        self.mark[own] = 0
        first = np.repeat(np.cumsum(n) - n, n)
        met = np.cumsum(common)
        met -= (met - common)[first] if len(met) else 0
        place = upto[code] + np.arange(len(code)) - first + 1 - met  # of a hash in the union of both
        full = np.maximum(n, self.n[i]) >= SKETCH
        union = n + self.n[i] - np.bincount(which, common, len(others)).astype(np.int64)
        common[full[which] & (place > SKETCH)] = 0  # the smallest of the union decide
        shared = np.bincount(which, common, len(others)).astype(np.int64)
        both = np.where(full, np.minimum(union, SKETCH), union)
        return (both == 0) | (shared >= least * both)


def _similar(least: float):
    """(a, b) of rows (a, b, sa, sb) whose sketches are as similar as that."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keep = [alike(*(np.frombuffer(v.as_py(), "<u4") for v in p), least) for p in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(distance: int, least: float, views: int, far: int):
    """From a block of rows (stray, piece, sketch, fp0, ...): pairs of pieces of which a stray and another row are similar
    and near in one view, as many as join the block's pieces."""

    def run(block):
        import numpy as np
        import pyarrow as pa

        stray, piece = (block[c].to_numpy() for c in ("stray", "piece"))
        fps = [block[f"fp{k}"].to_numpy().view(np.uint64) for k in range(views)]
        sketch = _Sketches([np.frombuffer(v.as_py(), "<u4") for v in block["sketch"]])
        rows, others, up, out = np.flatnonzero(stray), np.flatnonzero(~stray), {}, []

        def root(k):
            while k in up:
                k = up[k]
            return k

        for i in rows:
            d = np.stack([np.bitwise_count(x[i] ^ x[others]) for x in fps])
            near = (d.min(0) <= distance) & (d.max(0) <= far)
            near = others[near & (piece[others] != piece[i])]
            for j in near[sketch.alike(i, near, least)] if len(near) else ():
                a, b = root(piece[i]), root(piece[j])
                if a != b:
                    up[a] = b
                    out.append((piece[i], piece[j]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def star(edges: DataFrame, most: int = 60) -> DataFrame:
    """(u, v): v is the smallest node of u's component, for every node u that is not it. edges: a, b (long)."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, written(small.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "small")
        dropped(old, large)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return e
        mark = now
    raise RuntimeError(f"components did not settle in {most} rounds")


def verified(nodes: DataFrame, candidates: DataFrame, sure: DataFrame, sketches: DataFrame, distance: int, similarity: float, far: int = 64) -> DataFrame:
    """What star gives, of all pairs of nodes that are near and similar. candidates: edges with the components of all near
    pairs; sure: the similar ones of them. Where a candidate component falls into several pieces, an edge that the forest
    left out may join them: all near pairs between its pieces are looked at, each block of strays (rows outside the
    largest piece) against each block of the component."""
    views = [c for c in nodes.columns if c.startswith("fp")]
    pieces = star(sure)
    of = lambda n: pieces.select(F.col("u").alias(f"u{n}"), F.col("v").alias(f"v{n}"))
    e = candidates.join(of("a"), F.col("a") == F.col("ua"), "left").join(of("b"), F.col("b") == F.col("ub"), "left")
    split = written(e.select(F.coalesce("va", "a").alias("a"), F.coalesce("vb", "b").alias("b")).where("a <> b").distinct(), "split")
    if split.isEmpty():
        return pieces
    parts = star(split)
    parts = written(parts.union(parts.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("piece"), F.col("v").alias("part")), "parts")
    rows = nodes.join(of("n"), F.col("node") == F.col("un"), "left").withColumn("piece", F.coalesce("vn", "node")).join(parts, "piece").select("part", "piece", "node", *views)
    rows = written(rows, "pieces_rows")
    sizes = rows.groupBy("part", "piece").agg(F.count("*").alias("n")).groupBy("part").agg(F.sum("n").alias("n"), F.max(F.struct("n", "piece")).alias("most"))
    # Of two nodes the one pair has been looked at.
    sizes = sizes.where("n > 2").select(F.col("part").alias("p"), F.col("most.piece").alias("main"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("ks"), F.ceil(F.col("n") / BLOCK).alias("kn"))
    rows = rows.join(sizes, F.col("part") == F.col("p")).join(sketches, "node")
    at = lambda k: F.pmod(F.xxhash64("node"), F.col(k))
    deal = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    strays = rows.where("piece <> main").select("part", at("ks").alias("i"), deal("kn").alias("j"), F.lit(True).alias("stray"), "piece", "sketch", *views)
    others = rows.select("part", deal("ks").alias("i"), at("kn").alias("j"), F.lit(False).alias("stray"), "piece", "sketch", *views)
    more = strays.unionByName(others).groupBy("part", "i", "j").applyInArrow(_across(distance, similarity, len(views), far), "a long, b long")
    more = written(more, "more")
    if more.isEmpty():
        return pieces
    joined = star(more)
    to = joined.select(F.col("u").alias("k"), F.col("v").alias("to"))
    return pieces.join(to, F.col("v") == F.col("k"), "left").select("u", F.coalesce("to", "v").alias("v")).union(joined)


def grouped(prints: DataFrame, distance: int, similarity: float | None = None, far: int = 64) -> DataFrame:
    """prints (a written table with id, fp0, ...) with component_id and its root, a node. Rows alike in all views are one
    node; with a similarity, only if their sketches are alike too, and links are those whose sketches are as similar."""
    views = [c for c in prints.columns if c.startswith("fp")]
    node = F.xxhash64(*views, "sketch") if similarity else F.col(views[0]) if len(views) == 1 else F.xxhash64(*views)
    banded = [F.min("bands").alias("bands")] if "bands" in prints.columns else []
    nodes = prints.withColumn("node", node).groupBy("node", *views).agg(F.min("id").alias("least"), *banded, *([F.min(F.struct(F.col("id").isNull(), "id", "h")).getField("h").alias("row")] if similarity else []))
    nodes = written(nodes, "nodes")
    e = links(nodes.drop("least", "row"), distance, (distance // 3, 2 * distance // 3, distance) if similarity else None, far)
    if similarity:
        e = written(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
        ends = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        own = nodes.join(ends, "node", "left_semi").select("node", F.col("row").alias("h"))
        sketches = written(prints.select("h", "sketch").join(own, "h").groupBy("node").agg(F.first("sketch").alias("sketch")), "sketches")
        side = lambda n: sketches.select(F.col("node").alias(n), F.col("sketch").alias(f"s{n}"))
        sure = e.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(tidy(_similar(similarity)), "a long, b long")
        roots = verified(nodes.select("node", *views), e, written(sure, "sure"), sketches, distance, similarity, far)
    else:
        roots = star(e)
    member = nodes.join(roots, F.col("node") == F.col("u"), "left").select("node", "least", F.coalesce("v", "node").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    of = member.join(least, F.col("root") == F.col("r")).select(F.col("node").alias("n"), "root", "component_id")
    return prints.withColumn("node", node).join(of, F.col("node") == F.col("n"), "left").drop("node", "n", "sketch", "bands")


def simhash(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id of every row."""
    out = grouped(written(fingerprints(docs, words, id_col, text_col), "prints"), distance)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, distance: int = 9, similarity: float = 0.8, far: int = 16, print_words: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with its columns, of each group of near copies: the one with the smallest id.

    Rows link where their sets of five-word shingles are similar (Jaccard) to 0.8 or more. Candidates come from two views of
    64 bits of the distinct two-word shingles: an edited word changes two of those but five of the five-word shingles, so
    similar texts are nearer there, and the search may be narrower. Two texts are candidates if one view differs in at
    most 9 bits and the other in at most 16. By the binomial model of the views that finds 99% of the pairs at 0.8 whose
    words were changed one by one, and more above; groups need only some of their pairs."""
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    prints = written(near_prints(docs, words, print_words, 2, id_col, text_col), "prints")
    groups = grouped(prints, distance, similarity, far)
    # No id and h of its own may repeat in a component: those are repeated rows, of which one stays.
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h")).alias("best"))
    keep = written(best.select(F.col("best.id").alias("_id"), F.col("best.h").alias("_h")), "keep")
    chosen = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    stay = chosen.join(keep, F.col("_key") == F.col("_h"), "left_semi")
    repeated = written(prints.groupBy("h").count().where("count > 1").join(keep, F.col("h") == F.col("_h"), "left_semi").select(F.col("h").alias("_r")), "repeated")
    if not repeated.isEmpty():
        twice = chosen.join(repeated, F.col("_key") == F.col("_r"), "left_semi").dropDuplicates(["_key"])
        stay = stay.join(repeated, F.col("_key") == F.col("_r"), "left_anti").unionByName(twice)
    return stay.select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(documents(spark, sf_dir))
