"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once per document and stores the measurements and one bit per
failed rule. A policy is a named, versioned set of rules: `apply_policy` needs only the bits, and
`ablations` computes, by bitwise aggregation over the ledger, what each rule rejects alone and
what a policy would reject without it. No document is read a second time for a new policy.

Defined results: a null or empty text has no words, so it fails `few_words`; repeated rows get one
ledger row each; other columns of the input are ignored, whatever their names; an empty table
gives an empty ledger. A text of any length is always measured whole; a null doc_id is an id like any other;
rules are conditions, so measurements that tie with a bound are told by it alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import WORD, let, words

#: rule -> condition over the measurements that a failing document meets. Bit i belongs to rule i; new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "2 * n_upper > n_letters",
    "exclamations": "5 * n_bangs > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "few_letters": "2 * n_letters < word_chars",
    "long_words": "word_chars > 25 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_bangs")


@dataclass(frozen=True)
class Policy:
    """A named version of the rules that reject a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in set(self.rules))


BASE_POLICY = Policy("base", 1, BASE)
PROSE_POLICY = Policy("prose", 1, tuple(RULES))


def repeated_window_words(tokens: Column) -> Column:
    """How many words stand in a three-word window that occurs twice or more among tokens.

    Only texts whose windows' hashes aren't all different go on: their windows are sorted by hash beside their position,
    so equal windows become neighbours; the rest is the total length of a union of intervals of three. n log n in the
    length of the text.
    """

    def hashed(t):
        return F.transform(F.sequence(F.lit(0), F.size(t) - 3), lambda i: F.xxhash64(F.get(t, i), F.get(t, i + 1), F.get(t, i + 2)))

    def placed(hashes):
        return F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def repeated(s):
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))

    def covered(r):
        return F.aggregate(F.transform(r, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(r, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    positions = lambda hashes: F.sort_array(F.transform(let(F.sort_array(placed(hashes)), repeated), lambda x: x["i"]))
    words_of = lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(positions(hashes), covered))
    return F.when(F.size(tokens) < 3, 0).otherwise(let(tokens, lambda t: let(hashed(t), words_of))).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measurements of every document."""
    text = F.coalesce(F.col("_t"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
        .withColumn("_w", words(F.col("_t")))
        .withColumn("_l", lines)
        .select(
            "doc_id",
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size("_l").cast("long").alias("n_lines"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            repeated_window_words(F.col("_w")).alias("n_repeat_words"),
            F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long").alias("n_letters"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(text, F.lit("!")).cast("long").alias("n_bangs"),
        )
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, measurements and `failed`, the bits of all rules that the document fails."""
    failed = sum((F.when(F.expr(cond), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, cond in RULES.items()), F.lit(0).cast("long"))
    return measured(docs, id_col, text_col).withColumn("failed", failed)


def fails(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(ledger_df: DataFrame, policy: Policy = PROSE_POLICY) -> DataFrame:
    """The ledger with the policy's verdict in `kept`."""
    return ledger_df.withColumn("kept", ~fails(policy))


def ablations(ledger_df: DataFrame, policy: Policy = PROSE_POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that the policy would reject without it.

    One aggregate over the distinct bit patterns, of which there are at most 2^rules.
    """
    patterns = ledger_df.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules))).alias("r")
    rows = patterns.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    counted = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("rule").agg(
        counted(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        counted(F.col("bits") == F.col("bit")).alias("n_only_this"),
        counted(F.col("bits").bitwiseAND(F.bitwise_not("bit")) != 0).alias("n_rejected_without"),
    )


def kept_documents(docs: DataFrame, policy: Policy = PROSE_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the policy keeps. One pass: verdicts stay beside their row."""
    row = docs.select(F.struct("*").alias("_row"))
    judged = apply_policy(_beside(row, text_col), policy)
    return judged.where("kept").select("_row.*")


def _beside(row: DataFrame, text_col: str) -> DataFrame:
    return ledger(row.select(F.struct("_row").alias("_id"), F.col("_row")[text_col].alias("_text")), "_id", "_text").withColumn("_row", F.col("doc_id._row"))


def digest(docs: DataFrame, policy: Policy = PROSE_POLICY) -> DataFrame:
    """The query's columns: the base measurements, the base verdict and the policy's, from one ledger."""
    return apply_policy(ledger(docs), policy).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails(BASE_POLICY).alias("base_failed"), (F.col("kept") & ~fails(BASE_POLICY)).alias("kept"), F.col("failed").alias("failed_rules"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
k AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS win FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM k),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + j AS p FROM r, (VALUES (0), (1), (2)) AS o(j) WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
    length(t) - length(replace(t, '!', '')) AS n_bangs
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id),
f AS (SELECT *, CAST(
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_upper > n_letters THEN 8 ELSE 0 END
    + CASE WHEN 5 * n_bangs > n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 64 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 128 ELSE 0 END AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed AS failed_rules FROM f
"""
