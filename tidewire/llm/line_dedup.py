"""Line dedup over overlapping windows of three lines.

Every three consecutive lines of a text are a window. Windows are hashed (128 bits) within their row; of
a window that occurs more than once in all documents, the first occurrence, by document and position,
stays, and every later one marks its three lines. A document loses the union of the lines so marked.

Only hashes and positions are shuffled to find repeats: counts are combined before the shuffle, and the
one row per repeated hash is joined back to the occurrences, a join that can be split where a window is
everywhere. Positions are gathered per document, which its own length bounds; removal is linear in it.

Defined results: a null text stays null; a text of fewer than three lines has no window and stays; a
window without a word is never a repeat, so blank lines separate; rows that are equal in doc_id and text
are one document, which keeps its first occurrences in each of its rows: a row that a loader wrote twice, or a
task again, must not empty the document, and which of two equal rows came first could not be told apart in a
second run; a null doc_id sorts first, and of windows that tie in document and position none is later; texts of
any length are cut whole; an empty table gives no rows; other columns are ignored by `deduped`, whatever their
names, and kept by `cleaned`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import WORD, let, text_key

WINDOW = 3


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, fp, pos, h1, h2: each window of each text, by two 64-bit hashes."""

    def hashed(lines: Column) -> Column:
        def window(i: Column) -> Column:
            parts = [F.get(lines, i + k) for k in range(WINDOW)]
            worded = parts[0].rlike(WORD)
            for p in parts[1:]:
                worded = worded | p.rlike(WORD)
            return F.when(worded, F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2")))

        return F.when(F.size(lines) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(lines) - WINDOW), window))

    keyed = docs.select("doc_id", text_key(F.col("text")).alias("fp"), let(F.split("text", "\n"), hashed).alias("_w"))
    return keyed.select("doc_id", "fp", F.posexplode("_w").alias("pos", "_h")).where("_h IS NOT NULL").select("doc_id", "fp", "pos", "_h.h1", "_h.h2")


def later_positions(docs: DataFrame) -> DataFrame:
    """doc_id, fp and the sorted positions of windows that are not the first of their content."""
    seen = windows(docs)
    repeated = seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "fp", "pos")).alias("first")).where("n > 1").drop("n")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("fp") == F.col("first.fp")) & (F.col("pos") == F.col("first.pos"))
    later = seen.join(repeated, ["h1", "h2"]).where(~first)
    return later.groupBy("doc_id", "fp").agg(F.sort_array(F.collect_set("pos")).alias("later"))


def kept_lines(lines: Column, later: Column) -> Column:
    """The lines outside all windows that start at the sorted positions `later`: what lies before, between and behind them."""

    def cut(p: Column) -> Column:
        behind = F.transform(p, lambda x, k: F.slice(lines, x + WINDOW + 1, F.greatest(F.lit(0), F.coalesce(F.get(p, k + 1), F.size(lines)) - x - WINDOW)))
        return F.flatten(F.concat(F.array(F.slice(lines, F.lit(1), F.get(p, F.lit(0)))), behind))

    return F.when(later.isNull(), lines).otherwise(let(later, cut))


def _cut(docs: DataFrame) -> DataFrame:
    """Each row of docs in `_row`, with `_lines` and the lines `_kept` of them."""
    marks = later_positions(docs).select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), "later")
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_d0"), text_key(F.col("text")).alias("_f0"))
    both = row.join(marks, F.col("_d0").eqNullSafe(F.col("_d")) & (F.col("_f0") == F.col("_f")), "left")
    return both.withColumn("_lines", F.split("_row.text", "\n")).withColumn("_kept", kept_lines(F.col("_lines"), F.col("later")))


def deduped(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text."""
    n = F.coalesce(F.size("_lines"), F.lit(0))
    n = F.when(F.col("_lines").isNull(), 0).otherwise(n)
    removed = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept"))
    return _cut(docs.select("doc_id", "text")).select(F.col("_row.doc_id").alias("doc_id"), n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.array_join("_kept", "\n").alias("text"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with the remaining text; n_chars, if there is one, follows it. Rows that lose every line go."""
    cut = _cut(docs).where("_lines IS NULL OR size(_kept) > 0")
    text = F.array_join("_kept", "\n")
    lengths = {"n_chars": F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col("_row.n_chars"))} if "n_chars" in docs.columns else {}
    return cut.select(*(({"text": text} | lengths).get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]')),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (VALUES (0), (1), (2)) AS o(j) WHERE k > 1),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l),
a AS (SELECT x.doc_id, count(*) AS n_lines, count(c.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY x.i) FILTER (WHERE c.i IS NULL), '') AS text
      FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_removed, 0) AS n_removed, a.text FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""
