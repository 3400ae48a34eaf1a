"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations read the bits alone.

Ledger. One pass over the whole texts gives each row its measurements; each rule is a predicate over them and owns one bit
of `failures`. Texts are not read again: the ledger (id, measurements, bits) is written as a table, and whatever is decided
later is decided from it.

Policies. A version names the rules that count and how many of them a document may fail. It is applied as
bit_count(failures & mask) <= allowed, so a new version costs one scan of a narrow column. Bits of rules are never given
to other rules; a rule that changes becomes a new rule with a new bit.

Ablations. Rows are first counted by their bits under the policy, with map-side combining, so at most 2 to the number of
its rules rows are left, whatever the corpus. From these come, for each rule: documents that fail it, those that it alone
rejects, and documents and words kept without it; and for a group of rules left out at once, likewise.

Measurements. Words are runs of [^\\x20\\x09-\\x0D]; lines are what \\n splits, and count where they have a word.
n_repeat_words is the number of words inside some window of WINDOW words that stands twice or more in the text, the first
included; windows are compared exactly, by doubling ranks (words, pairs, fours, eights), not by hashes. n_same_words counts
words that repeat the word before.

Defined results: a null text has no words, as an empty one; all other measurements of such a text are 0, and of the rules
it fails only the one on few words; a null id stays null; repeated rows are rows of their own; an empty table gives an
empty one. Memory is linear in a single text and does not grow with the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chiasma.llm.common import documents, tidy, written

NAME = "op11_quality_rules"
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_digits", "n_bullet_lines", "n_ellipsis_lines", "longest_word", "n_same_words")

#: Rule, and when a row fails it; its place is its bit. All are over whole numbers, so every engine decides alike.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("few_letter_words", "100 * n_letter_words < 70 * n_words"),
    ("digits", "100 * n_digits > 30 * word_chars"),
    ("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("bullets", "n_lines >= 4 AND 100 * n_bullet_lines > 90 * n_lines"),
    ("ellipses", "n_lines >= 4 AND 100 * n_ellipsis_lines > 30 * n_lines"),
    ("endless_word", "longest_word > 1000"),
    ("very_long", "n_words > 100000"),
    ("same_words", "100 * n_same_words > 30 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """Rules that count, and how many of them a kept document may fail."""

    rules: tuple[str, ...]
    allowed: int = 0

    def mask(self, rules=RULES) -> int:
        names = [n for n, _ in rules]
        return sum(1 << names.index(r) for r in set(self.rules))


#: Versions. "base" is the part that every later one contains; "2" is in production; "strict" also drops very long texts.
POLICIES = {
    "base": Policy(("few_words", "repeated_windows")),
    "1": Policy(("few_words", "repeated_windows", "symbols", "few_letter_words")),
    "2": Policy(tuple(n for n, _ in RULES if n != "very_long")),
    "strict": Policy(tuple(n for n, _ in RULES)),
}
PRODUCTION = "2"


def _repeat_words(ids, window: int) -> int:
    """Words that lie in windows found twice or more. ids: a number for each word, alike for like words."""
    import numpy as np

    n = len(ids) - window + 1
    if n < 2:
        return 0
    rank, width = ids, 1
    while width < window:  # rank of the run of `width` words at each place -> of a longer one, from two that overlap
        step = min(width, window - width)
        m = len(rank) - step
        _, rank = np.unique(rank[:m] * np.int64(len(ids) + 1) + rank[step : step + m], return_inverse=True)
        width += step
    at = np.flatnonzero(np.bincount(rank)[rank] > 1)
    return int(np.minimum(np.diff(at), window).sum()) + window if len(at) else 0


def _word_ids(raw: bytes, starts):
    """A number for each word; words are cut out in slices, so only the distinct ones are held."""
    import numpy as np

    known: dict[bytes, int] = {}
    out, slice_ = np.empty(len(starts), np.int64), 1 << 16
    for k in range(0, len(starts), slice_):
        end = int(starts[k + slice_]) if k + slice_ < len(starts) else len(raw)
        words = raw[int(starts[k]) : end].split()
        out[k : k + len(words)] = [known.setdefault(w, len(known)) for w in words]
    return out


def _measures(window: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        space, follows, letter = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
        space[[32, *range(9, 14)]] = True
        follows[0x80:0xC0] = True  # bytes of a code point after its first
        letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
        symbols = [ord(c) for c in SYMBOLS]

        def measure(text):
            raw = (text.as_py() or "").encode()
            a = np.frombuffer(raw, np.uint8)
            gap = space[a]
            starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(a) else np.zeros(0, np.int64)
            if not len(starts):
                return (0,) * len(MEASURES)
            counts = np.bincount(a, minlength=256)
            length = np.add.reduceat((~gap & ~follows[a]).astype(np.int64), starts)
            lettered = np.logical_or.reduceat(letter[a], starts)
            lines = [x for x in raw.split(b"\n") if x.strip()]
            ids = _word_ids(raw, starts)
            return (
                len(starts), int(length.sum()), int(counts[symbols].sum()), len(lines) - len(set(lines)), _repeat_words(ids, window),
                len(lines), int(lettered.sum()), int(counts[48:58].sum()), sum(x.strip().startswith((b"-", b"*", "•".encode())) for x in lines),
                sum(x.strip().endswith((b"...", "…".encode())) for x in lines), int(length.max()), int((ids[1:] == ids[:-1]).sum()),
            )

        for b in batches:
            rows = [measure(t) for t in b.column(1)]
            columns = zip(*rows, strict=True) if rows else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["id", *MEASURES])

    return run


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id and MEASURES of every row, in one pass over the texts."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return d.mapInArrow(tidy(_measures(window)), "id long, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """measures() with `failures`: bit k is set where the k-th rule fails. Any rules over the measurements, at most 63."""
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    bits = [F.when(F.expr(fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, (_, fails) in enumerate(rules)]
    out = measures(docs, id_col, text_col)
    failures = F.lit(0).cast("long")
    for b in bits:
        failures = failures.bitwiseOR(b)
    return out.withColumn("failures", failures)


def counted(policy: Policy, rules=RULES) -> Column:
    """The failures that count under the policy, as bits."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask(rules)).cast("long"))


def keeps(policy: Policy, rules=RULES) -> Column:
    """Whether the policy keeps a row of a ledger."""
    return F.bit_count(counted(policy, rules)) <= policy.allowed


def ablations(ledger: DataFrame, policies: dict[str, Policy] | None = None, rules=RULES) -> DataFrame:
    """policy, rule, n_failed, n_alone (documents that the policy keeps as soon as the rule is left out), n_kept,
    kept_without, words_kept, words_without: a row for each policy and each of its rules."""
    names, out = [n for n, _ in rules], None
    for version, p in (policies or POLICIES).items():
        pattern = ledger.groupBy(counted(p, rules).alias("bits")).agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
        ruled = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in sorted(set(p.rules), key=names.index)]))
        fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
        kept = F.bit_count("bits") <= p.allowed
        without = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not("bit"))) <= p.allowed
        total = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("long")
        one = pattern.select("bits", "n", "words", ruled.alias("r")).select("bits", "n", "words", "r.*").groupBy("rule").agg(
            total(fails, F.col("n")).alias("n_failed"), total(without & ~kept, F.col("n")).alias("n_alone"), total(kept, F.col("n")).alias("n_kept"),
            total(without, F.col("n")).alias("kept_without"), total(kept, F.col("words")).alias("words_kept"), total(without, F.col("words")).alias("words_without"),
        ).select(F.lit(version).alias("policy"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def kept_without(ledger: DataFrame, policy: Policy, left_out: list[tuple[str, ...]], rules=RULES) -> DataFrame:
    """left_out (names joined by +), n_kept: documents kept when each of the given groups of rules is left out at once."""
    pattern = ledger.groupBy(counted(policy, rules).alias("bits")).agg(F.count("*").alias("n"))
    groups = F.array(*[F.struct(F.lit("+".join(g)).alias("left_out"), F.lit(Policy(g).mask(rules)).cast("long").alias("mask")) for g in left_out])
    kept = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not("mask"))) <= policy.allowed
    return pattern.select("bits", "n", F.explode(groups).alias("g")).select("bits", "n", "g.*").groupBy("left_out").agg(F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).cast("long").alias("n_kept"))


def judged(ledger: DataFrame, version: str = PRODUCTION, policies: dict[str, Policy] | None = None, rules=RULES) -> DataFrame:
    """A written ledger with `kept`, `policy`, `sole_rule` (the rule without which the document would be kept; null
    where it is kept, or rejected by more) and `sole_rule_docs` (how many documents that rule alone rejects)."""
    policies = policies or POLICIES
    p = policies[version]
    sole = F.lit(None).cast("string")
    for k, (name, _) in enumerate(rules):
        if name in p.rules:
            sole = F.when(~keeps(p, rules) & (counted(p, rules) == (1 << k)), name).otherwise(sole)
    effect = ablations(ledger, {version: p}, rules).select(F.col("rule").alias("sole_rule"), F.col("n_alone").alias("sole_rule_docs"))
    out = ledger.withColumns({"kept": keeps(p, rules), "policy": F.lit(version), "sole_rule": sole})
    return out.join(F.broadcast(effect), "sole_rule", "left")  # a row for each rule


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = written(ledger(documents(spark, sf_dir)), "ledger")
    out = judged(book).withColumn("base_failed", ~keeps(POLICIES["base"]))
    return out.select(F.col("id").alias("doc_id"), *MEASURES, "base_failed", "kept", "failures", "policy", "sole_rule", "sole_rule_docs")


def _oracle() -> str:
    bit = lambda k: f"CASE WHEN {RULES[k][1]} THEN {1 << k} ELSE 0 END"
    p = POLICIES[PRODUCTION].mask()
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (SELECT r, i, list_aggregate(list_slice(ws, i, i + {WINDOW - 1}), 'string_agg', ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, CAST(sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM again) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup,
    count(*) FILTER (regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]')) AS bullets, count(*) FILTER (regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS ellipses
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
words AS (SELECT r, count(*) FILTER (regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')) AS lettered, max(length(x)) AS longest FROM (SELECT r, unnest(ws) AS x FROM w) GROUP BY r),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lettered, 0) AS BIGINT) AS n_letter_words, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) AS n_digits,
    CAST(coalesce(bullets, 0) AS BIGINT) AS n_bullet_lines, CAST(coalesce(ellipses, 0) AS BIGINT) AS n_ellipsis_lines, CAST(coalesce(longest, 0) AS BIGINT) AS longest_word, CAST(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS BIGINT) AS n_same_words
    FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r) LEFT JOIN words USING (r)),
f AS (SELECT *, CAST({" + ".join(bit(k) for k in range(len(RULES)))} AS BIGINT) AS failures FROM m),
k AS (SELECT *, failures & {POLICIES["base"].mask()} <> 0 AS base_failed, failures & {p} = 0 AS kept, '{PRODUCTION}' AS policy,
    CASE failures & {p} {" ".join(f"WHEN {1 << k} THEN '{n}'" for k, (n, _) in enumerate(RULES) if n in POLICIES[PRODUCTION].rules)} END AS sole_rule FROM f)
SELECT doc_id, {", ".join(MEASURES)}, base_failed, kept, failures, policy, sole_rule, CASE WHEN sole_rule IS NOT NULL THEN count(*) OVER (PARTITION BY sole_rule) END AS sole_rule_docs FROM k"""


ORACLE_SQL = _oracle()
