"""Token counts without token ids.

A text's tokens are those of its pre-tokens, so their number is the sum over its distinct pre-tokens of (times in the
text) x (pieces of the pre-token). Three steps:

1. Count pre-tokens over the corpus (each task sums its own first) and let the tokenizers library count the pieces of
   each distinct one once: a table (pretoken, freq, pieces), written in the shared folder.
2. Take each document's pre-token frequencies. Pre-tokens more frequent than a threshold are joined on the way: their
   piece counts are a broadcast table of at most HEAD rows, and they are the ones whose key would be hot in a shuffle.
   The threshold follows from a histogram of the frequencies, so the bound holds for any corpus.
3. The rest, a few hundredths of the occurrences and none of them hot, is joined by a shuffle on the pre-token. Sums per
   document follow.

Texts are taken apart by the tokenizer's pattern where all Unicode versions agree on their characters, else by the
library's own normaliser and splitter (see pretokens). Only texts that hold one of the tokenizer's special strings, or a
tokenizer of another kind, are counted by the library as a whole, in step 2.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows give repeated rows;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiasma.llm.common import documents, repeated, written
from chiasma.llm.pretokens import pretokens

NAME = "op4_token_counts"
TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
#: Rows of the broadcast table, and bytes of its pre-tokens for each row allowed: 16 MB of them at most.
HEAD, HEAD_BYTES = 1 << 18, 64
#: Distinct pre-tokens that a task sums before it passes them on; those of more bytes than LONGEST are never broadcast, and
#: as each text that holds one is as long, there are few rows with them for the bytes read.
FLUSH, LONGEST = 100_000, 1 << 20
#: Rows that a task gathers for one Arrow batch.
BATCH = 20_000


def _count_pretokens(name: str):
    def run(batches):
        import pyarrow as pa

        p, seen = pretokens(name), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pretoken", "freq"])

        for b in batches:
            for text in b.column(0):
                if (parts := p.find(text.as_py() or "")) is not None:
                    seen.update(parts)
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return run


def _count_pieces(name: str):
    def run(batches):
        import pyarrow as pa

        p = pretokens(name)
        for b in batches:
            words = b.column(0).to_pylist()
            n = list(map(len, p.pieces(words)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32())], ["pretoken", "freq", "pieces"])

    return run


def _frequencies(name: str, head):
    """A row for each document with what the broadcast table counts, and one for each other distinct pre-token in it."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        p, pieces = pretokens(name), head.value
        schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n_bytes", pa.int64()), ("n_head", pa.int64()), ("pretoken", pa.string()), ("freq", pa.int64())])
        for b in batches:
            rows = [[] for _ in schema]

            def add(*row, rows=rows):
                for column, v in zip(rows, row, strict=True):
                    column.append(v)

            for doc, text in zip(b.column(0), b.column(1), strict=True):
                doc, text = doc.as_py(), text.as_py() or ""
                raw = text.encode()
                h = xxhash.xxh64_intdigest(raw) - (1 << 63)
                if (parts := p.find(text)) is None:
                    add(doc, h, len(raw), len(p.ids([text])[0]), f"\0{doc} {h}", None)
                    continue
                n, rest = 0, []
                for w, k in Counter(parts).items():
                    c = pieces.get(w)
                    if c is None:
                        rest.append((w, k))
                    else:
                        n += c * k
                # A key that no pre-token has keeps the document's own row out of the hot null key.
                add(doc, h, len(raw), n, f"\0{doc} {h}", None)
                for w, k in rest:
                    add(doc, h, None, None, w, k)
                if len(rows[0]) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                    for column in rows:
                        column.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def piece_table(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(pretoken, freq, pieces) over all texts, each distinct pre-token encoded once."""
    seen = docs.select(text_col).mapInArrow(_count_pretokens(tokenizer), "pretoken string, freq long")
    return seen.groupBy("pretoken").agg(F.sum("freq").alias("freq")).mapInArrow(_count_pieces(tokenizer), "pretoken string, freq long, pieces int")


def head_of(table: DataFrame, most: int = HEAD) -> dict[str, int]:
    """pretoken → pieces of the most frequent ones, long ones among them: those above the lowest frequency that at most
    `most` of them, of HEAD_BYTES bytes on average, exceed."""
    level, fits = F.floor(F.log2("freq") * 16).cast("int"), F.octet_length("pretoken") <= LONGEST
    sizes = table.where(fits).groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("pretoken")).alias("size"))
    total, size, least = 0, 0, None
    for r in sizes.orderBy(F.desc("level")).collect():  # under 64 x 16 rows
        total, size = total + r["rows"], size + r["size"]
        if total > most or size > most * HEAD_BYTES:
            break
        least = r["level"]
    if least is None:
        return {}
    return {r.pretoken: r.pieces for r in table.where((level >= least) & fits).select("pretoken", "pieces").collect()}


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", head_rows: int = HEAD) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs. id_col is an integer column."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = written(piece_table(d, "text", tokenizer), "pieces")
    head = docs.sparkSession.sparkContext.broadcast(head_of(table, head_rows))
    per_doc = d.mapInArrow(_frequencies(tokenizer, head), "id long, h long, n_bytes long, n_head long, pretoken string, freq long")
    joined = per_doc.join(table.select("pretoken", "pieces"), "pretoken", "left")
    sums = joined.groupBy("id", "h").agg(F.count("n_head").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.sum(F.coalesce("n_head", F.col("freq") * F.col("pieces"))).alias("all"))
    return repeated(sums, "copies").select(F.col("id").alias(id_col), "n_bytes", F.expr("all div copies").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
