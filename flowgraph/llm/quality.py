"""Quality rules: measures of a document, and how often its lines occur across the documents of its host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, table

#: Fewer words, or a larger percentage of words in repeated windows, fail a document.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A line goes if more than this number of different texts of its host have it, however large the host is.
MAX_LINE_DOCS = 20
#: A document is depleted if fewer than ``MIN_WORDS``, or less than this share, of its words are left.
MIN_LEFT = 0.2

_BLANKS = "\t\n\x0b\x0c\r "


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: lambdas would evaluate a copied expression for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` of a text, as an array."""
    return F.array_remove(F.split(text, f"[{BLANK}]+"), "")


def covered(ws: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more.

    Windows are hashed; only texts with an equal pair go on. There the hashes are sorted with their places; equal
    neighbours are repeats, and the places of these, in order, cover ``min(window, distance to the next)`` words
    each. So it is n log n for texts of any length.
    """

    def body(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(_let(hashes, _covered_by_hash))

    def _covered_by_hash(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(_let(ordered, _repeats), _cover))

    def _repeats(o: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(o, i)["h"] == F.get(o, j)["h"], F.lit(False))
        marked = F.filter(o, lambda x, i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(marked, lambda x: x["i"]))

    def _cover(at: Column) -> Column:
        gap = lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window)))
        return F.aggregate(F.transform(at, gap), F.lit(0), lambda a, x: a + x)

    return _let(ws, body)


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(_BLANKS))) > 0


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.btrim(line, F.lit(_BLANKS))))


def document_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` and its measures ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    A null text has no words, so it fails. Whole texts are measured, however long.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    ws = words(text)
    lines = F.filter(F.split(text, "\n"), _has_word)
    df = df.withColumns(
        {
            "_m": _let(
                ws,
                lambda w: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    covered(w).cast("long").alias("n_repeat_words"),
                ),
            ),
            "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    failed = (F.col("_m.n_words") < MIN_WORDS) | (100 * F.col("_m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_m.n_words"))
    return df.withColumns(
        {
            "n_words": F.col("_m.n_words"),
            "word_chars": F.col("_m.word_chars"),
            "n_repeat_words": F.col("_m.n_repeat_words"),
            "base_failed": failed,
        }
    ).drop("_m")


def _lines(rows: DataFrame) -> DataFrame:
    """``doc_id, text_hash, host, at, line, line_words`` for each line with a word; ``at`` is its place among all lines."""
    told = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(i.alias("at"), _line_hash(x).alias("line"), F.size(words(x)).alias("line_words")),
    )
    lines = F.filter(told, lambda x: x["line_words"] > 0)
    return rows.select("doc_id", "text_hash", "host", F.explode(lines)).select("doc_id", "text_hash", "host", "col.*")


def without_lines(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the places ``gone``; the others stay as they are, in their order."""
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone)
    return _let(F.split(text, "\n"), lambda x: F.array_join(F.transform(left(x), lambda i: F.get(x, i)), "\n"))


def frequent_lines(rows: DataFrame, max_docs: int = MAX_LINE_DOCS) -> DataFrame:
    """``host, line`` (a hash) of lines that more than ``max_docs`` different texts of the host have.

    Copies of one text count once, so a large group of copies makes no line frequent. Counts are combined on the
    map side: a line that a third of all rows have is one row for each task.
    """
    lines = F.filter(F.split("text", "\n"), _has_word)
    once = rows.groupBy("host", "text_hash").agg(
        F.first(F.array_distinct(F.transform(lines, _line_hash))).alias("lines")
    )
    counts = once.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.filter(F.col("n_docs") > max_docs).select("host", "line")


def quality(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_LINE_DOCS,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, text_hash``, the measures, ``n_frequent_words`` (words in lines that go),
    ``kept``, ``gone_lines`` (their places; null if there are none) and ``clean_text``, the text without them. A text
    that loses no line is unchanged, and null stays null.

    Lines are compared without outer white space and case, by host (null is a host of its own). Each row is a document;
    rows equal in id and text get the same verdict. Empty and null texts have no words and fail; an empty table gives
    an empty result. Nothing but the three columns named is read.
    """
    rows = df.select(
        df[text_col].isNull().alias("_no_text"),
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col], F.lit("")).alias("text"),
        F.coalesce(df[host_col], F.lit("")).alias("host"),
    ).withColumn("text_hash", F.xxhash64("text"))
    frequent = frequent_lines(rows, max_docs).withColumnsRenamed({"host": "_fh", "line": "_fl"})
    gone = (
        _lines(rows)
        .join(frequent, (F.col("host") == F.col("_fh")) & (F.col("line") == F.col("_fl")), "left_semi")
        .groupBy("doc_id", "text_hash", "host", "at")
        .agg(F.max("line_words").alias("line_words"))  # rows that are repeated count once
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), F.col("host").alias("_gh"))
        .agg(F.sum("line_words").alias("n_frequent_words"), F.collect_list("at").alias("gone_lines"))
    )
    joined = document_measures(rows).join(
        gone,
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")) & (F.col("host") == F.col("_gh")),
        "left",
    ).withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)))
    left = F.col("n_words") - F.col("n_frequent_words")
    clean = F.when(F.col("gone_lines").isNotNull(), without_lines(F.col("text"), F.col("gone_lines"))).when(~F.col("_no_text"), F.col("text"))
    return joined.withColumns(
        {"kept": ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words")), "clean_text": clean}
    ).drop("_id", "_th", "_gh", "_no_text", "text")


def op3_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents")).drop("text_hash", "host", "clean_text", "gone_lines")


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)
),
g AS (
  SELECT doc_id, i, n, word, CASE WHEN i <= n - 4 THEN word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o
         || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS g
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
r AS (SELECT *, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM g),
v AS (
  SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM r
),
m AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (covered) AS n_repeat_words
  FROM v GROUP BY doc_id
),
l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS raw FROM d),
lw AS (
  SELECT *, lower(regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS line,
         len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS line_words
  FROM l WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM lw GROUP BY doc_id),
f AS (SELECT host, line FROM lw GROUP BY host, line HAVING count(DISTINCT text) > {MAX_LINE_DOCS}),
gone AS (SELECT doc_id, sum(line_words)::BIGINT AS n_frequent_words FROM lw SEMI JOIN f USING (host, line) GROUP BY doc_id),
a AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_frequent_words, 0) AS n_frequent_words
  FROM d LEFT JOIN m USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND n_words - n_frequent_words >= {MIN_WORDS} AND n_words - n_frequent_words >= {MIN_LEFT} * n_words AS kept
FROM a
"""
