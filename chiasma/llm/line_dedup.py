"""Line dedup by pairwise alignment.

Lines are compared lower-cased with white space collapsed. A line of at least LINE_WORDS words is a unit. Shorter lines
never align.

1. Find pairs. A block that may go has BLOCK_WORDS words or more, so two documents that share one share the hash of a line
   with the fewest lines after it that make so many words, and of a line with the fewest before it. A hash that is rare,
   held by at most RARE documents, pairs every two of its holders; any other pairs its later holders with the first (by
   id, nulls last, then text hash), so pairs are linear in the lines however many documents hold one. Between them these
   hashes cover every line of every block that a document shares with any earlier one. The hash of all its lines pairs a
   document with its first exact copy.
2. Align. For each pair all common lines are joined. Lines that are single in both documents are the anchors of a patience
   alignment: the longest increasing run of them, extended to both sides while lines agree; repeated lines are aligned in
   the gaps, in their order.
3. Delete. Aligned units next to each other in both documents make a block. Blocks of BLOCK_WORDS words or more go from
   the later document, with the blank lines inside them. Lines of it that were not aligned are aligned again until none
   is left that can be, as passages may stand in another order. What goes has a copy in an earlier document, which may lose it to a still earlier
   one only, so one copy stays.

Hot hashes, those of more than a bounded number of rows, are few, and meet their rows by a broadcast; documents paired
with very many others have their units dealt to several tasks.

Defined results: null and empty texts have no units and stay as they are; rows alike in id and text are one document and
keep or lose the same lines; an empty table gives an empty one; a document that loses all lines has an empty text; where
docs has a column deleted_blocks of its own, that one stays and the new one is deleted_blocks_.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiasma.llm.common import documents, tidy, written

NAME = "op3_line_dedup"
LINE_WORDS, BLOCK_WORDS, RARE = 3, 20, 8
#: Rows from which a key is hot: so many, and more in tables in which more than HOT_KEYS keys could have them.
HOT, HOT_KEYS = 1000, 100_000


def units(text: str | None) -> list[tuple[str, int, int]]:
    """(line, line number, words) of each unit."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        words = line.lower().split()
        if len(words) >= LINE_WORDS:
            out.append((" ".join(words), k, len(words)))
    return out


def spans(words: list[int], least: int) -> set[tuple[int, int]]:
    """The shortest stretches (first, last) of at least so many words from each unit on, and up to each unit."""
    ends, out, k = [0], set(), 0
    for n in words:
        ends.append(ends[-1] + n)
    for i in range(len(words)):
        k = max(k, i + 1)
        while k < len(words) and ends[k] - ends[i] < least:
            k += 1
        if ends[k] - ends[i] >= least:
            out.add((i, k - 1))
    i = 0
    for k in range(1, len(ends)):
        while i + 1 < k and ends[k] - ends[i + 1] >= least:
            i += 1
        if ends[k] - ends[i] >= least:
            out.add((i, k - 1))
    return out


def longest_run(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence that increases in both coordinates; pairs are distinct in each."""
    pairs, tails, at, back = sorted(pairs), [], [], []
    for k, (_, b) in enumerate(pairs):
        n = bisect_left(tails, b)
        tails[n:n + 1], at[n:n + 1] = [b], [k]
        back.append(at[n - 1] if n else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(first: list[list[int]], later: list[list[int]]) -> list[tuple[int, int]]:
    """A patience alignment: pairs (place in the first, place in the later) that ascend in both. first, later: for each
    common line, its places in the two documents."""
    line_a = {p: k for k, own in enumerate(first) for p in own}
    line_b = {p: k for k, own in enumerate(later) for p in own}

    def extended(chain, low, high):
        """The chain with its neighbours on either side, while lines agree; places lie between low and high."""
        out, last = [], low
        for k, (a, b) in enumerate(chain):
            if a <= last[0] or b <= last[1]:
                continue  # reached from the one before
            x, y, back = a - 1, b - 1, []
            while x > last[0] and y > last[1] and line_a.get(x, -1) == line_b.get(y, -2):
                back.append((x, y))
                x, y = x - 1, y - 1
            out += [*reversed(back), (a, b)]
            nx, ny = chain[k + 1] if k + 1 < len(chain) else high
            x, y = a + 1, b + 1
            while x < nx and y < ny and line_a.get(x, -1) == line_b.get(y, -2):
                out.append((x, y))
                x, y = x + 1, y + 1
            last = out[-1]
        return out

    low, high = (-1, -1), (1 << 60, 1 << 60)
    chain = extended(longest_run([(a[0], b[0]) for a, b in zip(first, later, strict=True) if len(a) == len(b) == 1]), low, high)
    marks = [low, *chain, high]
    in_a, in_b = [m[0] for m in marks], [m[1] for m in marks]
    gaps: dict[int, list] = {}
    for a, b in zip(first, later, strict=True):
        by_gap: dict[int, tuple] = {}
        for places, edges, side in ((a, in_a, 0), (b, in_b, 1)):
            for p in places:
                k = bisect_left(edges, p)
                if edges[k] != p:
                    by_gap.setdefault(k, ([], []))[side].append(p)
        for k, (x, y) in by_gap.items():
            if x and y:
                gaps.setdefault(k, []).extend(zip(x, y, strict=False))
    for k, pairs in gaps.items():
        chain += extended(longest_run(pairs), marks[k - 1], marks[k])
    return sorted(chain)


def blocks(first: list[list[int]], later: list[list[int]], words: list[int], least: int = BLOCK_WORDS) -> list[list[int]]:
    """Places in the later document of each aligned block that is to go. first, later, words: of each common line, its
    (ascending) places in the two documents and its words."""
    line, gone, left = {p: k for k, own in enumerate(later) for p in own}, [], later
    while pairs := aligned(first, left):
        found, last = [], (-9, -9)
        for p in pairs:
            if p == (last[0] + 1, last[1] + 1):
                found[-1].append(p[1])
            else:
                found.append([p[1]])
            last = p
        gone += [b for b in found if sum(words[line[p]] for p in b) >= least]
        done = {b for _, b in pairs}
        left = [[p for p in own if p not in done] for own in left]
    return gone


def _units(least: int):
    """Rows (id, h, key, places, lines, words, runs): each distinct unit of a document, where it stands among the units and
    in the text, and the hashes of the stretches that begin with it."""

    def run(batches):
        from xxhash import xxh64_digest, xxh64_intdigest

        for b in batches:
            rows = [[] for _ in range(7)]
            for i, h, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
                own = units(text.as_py())
                if not own:
                    continue
                i, h, n = i.as_py(), h.as_py(), len(own)
                digests = [xxh64_digest(x) for x, _, _ in own]
                each: dict[bytes, tuple] = {}
                for place, (d, (_, line, w)) in enumerate(zip(digests, own, strict=True)):
                    places, lines, _, _ = each.setdefault(d, ([], [], w, []))
                    places.append(place)
                    lines.append(line)
                stretches, known = spans([w for _, _, w in own], least), set()
                if sum(w for _, _, w in own) >= least:
                    stretches.add((0, n))  # all units, told apart from a stretch of the same lines inside a document
                for first, last in sorted(stretches):
                    r = xxh64_intdigest(b"".join(digests[first : last + 1]), 1 if last == n else 0) - (1 << 63)
                    if r not in known:
                        known.add(r)
                        each[digests[first]][3].append(r)
                for c, v in zip(rows, ([i] * len(each), [h] * len(each), [xxh64_intdigest(d) - (1 << 63) for d in each], *zip(*each.values(), strict=True)), strict=True):
                    c.extend(v)
                if len(rows[0]) >= 50_000:
                    yield _batch(rows)
                    rows = [[] for _ in range(7)]
            yield _batch(rows)

    return run


def _batch(rows):
    import pyarrow as pa

    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["id", "h", "key", "places", "lines", "words", "runs"])


def _deletions(least: int):
    """(id, h, block) of each block that the later document of a pair loses; rows: id, h and the pair's common units."""

    def run(batches):
        import pyarrow as pa

        span = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("lines", pa.list_(pa.int32()))])
        for b in batches:
            ids, hashes, out = [], [], []
            for i, h, shared in zip(*(b.column(k) for k in range(3)), strict=True):
                first, places, lines, words = (shared.values.field(k).to_pylist() for k in range(4))
                line = {p: x for own, at in zip(places, lines, strict=True) for p, x in zip(own, at, strict=True)}
                for x in blocks(first, places, words, least):
                    ids.append(i.as_py())
                    hashes.append(h.as_py())
                    out.append({"from": line[x[0]], "to": line[x[-1]], "lines": [line[p] for p in x]})
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(out, span)], ["id", "h", "block"])

    return run


def pairs(lines: DataFrame, rare: int = RARE) -> DataFrame:
    """first_id, first_h, id, h of the pairs of documents to be aligned. lines: a written table of units."""
    doc = F.struct(F.col("id").isNull().alias("z"), "id", "h")
    runs = lines.select(doc.alias("doc"), F.explode("runs").alias("run"))
    hot_rows = max(HOT, runs.count() // HOT_KEYS)
    firsts = runs.groupBy("run").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    firsts = written(firsts.where("first <> last").select(F.col("run").alias("r"), "first", "n"), "firsts")
    hot = F.broadcast(firsts.where(F.col("n") > hot_rows))  # at most HOT_KEYS rows
    met = runs.join(hot, F.col("run") == F.col("r")).select("run", "doc", "first", "n")
    rest = runs.join(hot, F.col("run") == F.col("r"), "left_anti").join(firsts.where(F.col("n") <= hot_rows), F.col("run") == F.col("r"))
    rest = written(rest.select("run", "doc", "first", "n"), "shared")
    with_first = met.unionByName(rest.where(F.col("n") > rare)).where("doc <> first").select("first", "doc")
    held = rest.where(F.col("n") <= rare).groupBy("run").agg(F.array_sort(F.collect_set("doc")).alias("docs"))  # at most `rare` documents
    two = held.select("docs", F.posexplode("docs").alias("k", "first")).select("first", F.explode(F.expr("slice(docs, k + 2, size(docs))")).alias("doc"))
    return with_first.unionByName(two).select(F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h"), "doc.id", "doc.h").distinct()


def deletions(keyed: DataFrame, least: int = BLOCK_WORDS, rare: int = RARE) -> DataFrame:
    """id, h, blocks (from, to, lines) of every document that loses lines. keyed: id, h (of the text), text."""
    schema = "id long, h long, key long, places array<int>, lines array<int>, words int, runs array<long>"
    lines = written(keyed.mapInArrow(tidy(_units(least)), schema), "units")
    two = written(pairs(lines, rare), "pairs")
    hot_pairs = max(HOT, two.count() // HOT_KEYS)
    many = two.groupBy("first_id", "first_h").count().where(F.col("count") > hot_pairs)
    many = F.broadcast(many.select(F.col("first_id").alias("hot_id"), F.col("first_h").alias("hot_h"), F.ceil(F.col("count") / hot_pairs).alias("salts")))  # at most HOT_KEYS rows
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    is_hot = F.col("first_id").eqNullSafe(F.col("hot_id")) & (F.col("first_h") == F.col("hot_h"))

    def own(docs, *columns):
        """The distinct units of these documents (i, t), those of repeated rows once."""
        some = lines.join(docs, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("t")), "left_semi")
        return some.select("id", "h", "key", *columns).dropDuplicates(["id", "h", "key"])

    later = own(two.select(F.col("id").alias("i"), F.col("h").alias("t")).distinct(), "places", "lines", "words")
    first = own(two.select(F.col("first_id").alias("i"), F.col("first_h").alias("t")).distinct(), "places")
    first = first.select(F.col("id").alias("first_id"), F.col("h").alias("first_h"), F.col("key").alias("k"), F.col("places").alias("first_places"))
    first = first.join(many, is_hot, "left").select(
        F.col("first_id").alias("e_id"), F.col("first_h").alias("e_h"), "k", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("e_salt"), "first_places")
    dealt = two.join(many, is_hot, "left").select("first_id", "first_h", F.col("id").alias("i"), F.col("h").alias("t"), F.pmod(F.xxhash64("id", "h"), salts).alias("salt"))
    later = later.join(dealt, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("t")))
    both = later.join(first, F.col("first_id").eqNullSafe(F.col("e_id")) & (F.col("first_h") == F.col("e_h")) & (F.col("key") == F.col("k")) & (F.col("salt") == F.col("e_salt")))
    shared = F.struct("first_places", "places", "lines", "words")
    of = both.groupBy("id", "h", "first_id", "first_h").agg(F.collect_list(shared).alias("shared"))  # at most a document's own lines
    gone = of.select("id", "h", "shared").mapInArrow(tidy(_deletions(least)), "id long, h long, block struct<from: int, to: int, lines: array<int>>")
    return gone.groupBy("id", "h").agg(F.array_sort(F.collect_set("block")).alias("blocks"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = BLOCK_WORDS, rare: int = RARE) -> DataFrame:
    """The rows of docs with their columns, text_col without the deleted lines, and deleted_blocks: array<struct<from, to>>
    of line numbers."""
    name = "deleted_blocks"
    while name in docs.columns:
        name += "_"
    text = F.col(f"`{text_col}`")
    row = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(text).alias("_h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    gone = deletions(row.select(F.col("_id").alias("id"), F.col("_h").alias("h"), F.col(f"_doc.`{text_col}`").alias("text")), least, rare)
    # Deletions grow with the corpus, so they are never broadcast, not even where they happen to be few.
    out = row.join(gone.hint("merge"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h")), "left")
    kept = F.array_join(F.transform(
        F.filter(
            F.transform(F.split(F.col(f"_doc.`{text_col}`"), "\n", -1), lambda x, k: F.struct(x.alias("x"), k.cast("int").alias("k"))),
            lambda s: ~F.exists("blocks", lambda b: F.array_contains(b["lines"], s["k"]) | ((s["k"] > b["from"]) & (s["k"] < b["to"]) & (F.trim(s["x"]) == ""))),
        ), lambda s: s["x"]), "\n")
    text_out = F.when(F.col("blocks").isNull(), F.col(f"_doc.`{text_col}`")).otherwise(kept)
    found = F.coalesce(F.transform("blocks", lambda b: F.struct(b["from"].alias("from"), b["to"].alias("to"))), F.array().cast("array<struct<from: int, to: int>>"))
    return out.select(*[text_out.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns], found.alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "text", "deleted_blocks")
