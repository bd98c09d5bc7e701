"""Source divergence audit: terms counted by a sort of token-start pointers, and chi-square distances of sources.

A text buffer is never cut into strings. Pointers to the starts of its terms are sorted as a multikey quicksort does: by
one digit of the terms (eight bytes at once), then every slice of pointers with an equal digit by its next digit, as long
as a slice holds several pointers and its terms go on. Runs of pointers to equal terms then give, by one pass, how often
and in how many documents of each group a term occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_n_per_group
from ..session import materialise
from .common import LOWER, UPPER, table
from .tokens import steps

#: A language keeps terms of so many of its documents; scale of the probabilities; ranks of terms that are returned.
MIN_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
#: Bytes of text whose pointers are sorted at a time.
SLICE_BYTES = 8 << 20
#: Sources whose distances to as many others are added up at a time, and numbers of a step.
TILE_SOURCES, STEP_CELLS = 1024, 1 << 20

_BYTES = np.arange(256)
#: Letters A-Z and a-z and all bytes of other scripts are parts of terms.
_PART = (_BYTES >= 0x80) | ((_BYTES | 32) >= 0x61) & ((_BYTES | 32) <= 0x7A) & (_BYTES >= 0x41)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_MASKS = np.array([((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(9)], np.uint64)


def term_pointers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the terms in the bytes of some documents, and the document of each; ``bounds`` are the
    documents' starts and the end of the last."""
    part = np.zeros(len(data) + 2, bool)
    part[1:-1] = _PART[data]
    starts, ends = part[1:] & ~part[:-1], part[:-1] & ~part[1:]  # at the first byte, and past the last
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    cut = inner[part[inner] & part[inner + 1]]  # a document begins where another's last term ends
    starts[cut] = ends[cut] = True
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) - at, np.searchsorted(bounds, at, "right") - 1


def sort_pointers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the terms by their bytes, and where in it each run of equal terms begins."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    window = np.ndarray(len(data) + 1, ">u8", padded, 0, (1,))
    order, fresh = np.arange(len(starts)), np.zeros(len(starts), bool)
    at, slices, depth = np.arange(len(starts)), None, 0
    while len(at):
        left = lengths[order[at]] - depth
        digit = window[starts[order[at]] + np.minimum(depth, lengths[order[at]])].astype(np.uint64) & _MASKS[np.minimum(left, 8)]
        by = np.argsort(digit) if slices is None else np.lexsort((digit, slices))
        order[at], digit = order[at][by], digit[by]
        new = np.concatenate([[True], digit[1:] != digit[:-1]])
        if slices is not None:
            new[1:] |= slices[1:] != slices[:-1]
        fresh[at] |= new
        run = np.cumsum(new) - 1
        deeper = (digit & np.uint64(0xFF) != 0) & (np.bincount(run)[run] > 1)  # eight whole bytes: the term may go on
        at, slices = at[deeper], run[deeper]
        depth += 8
    return order, np.flatnonzero(fresh)


def _strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)])
    flat = data[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])


def slice_counts(data: np.ndarray, bounds: np.ndarray, groups: np.ndarray):
    """Terms (sorted, as Arrow strings), and for each term and group with it: the term's place, the group, how often it
    occurs and in how many documents. ``groups`` has the group of each document."""
    data = _LOWER[data]
    starts, lengths, docs = term_pointers(data, bounds)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return pa.array([], pa.large_string()), none, none, none, none
    order, first = sort_pointers(data, starts, lengths)
    terms = _strings(data, starts[order[first]], lengths[order[first]])
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    # Documents are numbered by group, so that pairs of term and document are in the order of term and group.
    by_group = np.argsort(groups, kind="stable")
    number = np.empty(len(groups), np.int64)
    number[by_group] = np.arange(len(groups))
    pairs, times = np.unique(run * len(groups) + number[docs[order]], return_counts=True)
    place, group = pairs // len(groups), groups[by_group][pairs % len(groups)]
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (group[1:] != group[:-1])]))
    n_docs = np.diff(np.append(head, len(pairs)))
    return terms, place[head], group[head], np.add.reduceat(times, head), n_docs


def _pieces(data: np.ndarray, size: int):
    """A long text in pieces of about ``size`` bytes that end between terms."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and _PART[data[end - 1]] and _PART[data[end]]:
            inside = _PART[data[end : end + size]]
            end += int(np.argmin(inside)) if not inside.all() else len(inside)
        yield data[at:end]
        at = end


_COUNTS = "lang string, source string, term string, n long, n_docs long"


def _counted(size: int):
    def run(batches):
        for rows, texts in steps(batches, size):
            langs, sources = rows.flatten()
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            if len(data) > 2 * size and len(texts) == 1:  # one long text: its pieces' counts are those of one document
                some = []
                for piece in _pieces(data, size):
                    terms, place, _, times, _ = slice_counts(piece, np.array([0, len(piece)]), np.zeros(1, np.int64))
                    some.append(pa.table({"term": terms.take(pa.array(place)), "n": times}))
                whole = pa.concat_tables(some).group_by("term").aggregate([("n", "sum")]).combine_chunks()
                term, times = whole.column("term").combine_chunks(), whole.column("n_sum").to_numpy()
                group, n_docs = np.zeros(len(term), np.int64), np.ones(len(term), np.int64)
            else:
                groups = langs.dictionary_encode().indices.to_numpy().astype(np.int64) * len(sources)
                groups += sources.dictionary_encode().indices.to_numpy()
                _, one, groups = np.unique(groups, return_index=True, return_inverse=True)
                terms, place, group, times, n_docs = slice_counts(data, ends - ends[0], groups)
                term, group = terms.take(pa.array(place)), one[group]  # a document of the group has its names
            at = pa.array(group)
            columns = [langs.take(at), sources.take(at), term.cast(pa.string()), pa.array(times, pa.int64()), pa.array(n_docs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "n_docs"])

    return run


def term_counts(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """``lang, source, term, n, n_docs``: how often, and in how many documents, each term occurs in a group.

    Terms are runs of letters A-Z (lower-cased) and of all characters beyond ASCII. Nulls read as empty. Each row is a
    document. Counts are combined in each slice, then on the map side, so a term of all documents is one row a task.
    """
    empty = lambda c: F.coalesce(df[c].cast("string"), F.lit(""))
    rows = df.select(F.struct(empty(lang_col).alias("lang"), empty(source_col).alias("source")).alias("row"), empty(text_col).alias("text"))
    found = rows.mapInArrow(_counted(slice_bytes), _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _share(count: str, total: str) -> str:
    """SQL of ``1 + floor(SCALE * (count + 1) / total)``, exact for counts of any size."""
    return f"1 + (CAST({count} + 1 AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0))) div CAST({total} AS DECIMAL(20, 0))"


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same in numpy; counts too large for 64 bits go through Python's numbers."""
    if counts.size and int(counts.max()) >= (1 << 62) // SCALE:
        return 1 + ((counts.astype(object) + 1) * SCALE // totals.astype(object)).astype(np.int64)
    return 1 + (counts + 1) * SCALE // totals


def _distances(sent, first: int, second: int, tile: int):
    """In a task: the sum over its terms of ``(p - q)**2 // q`` for sources from ``first`` on against those from
    ``second`` on, by language. ``sent`` has the sources' totals by language."""

    def matrix(lists: pa.ListArray, begin: int, totals: np.ndarray) -> np.ndarray:
        entries = lists.flatten()
        place, n = (entries.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        some = (place >= begin) & (place < begin + len(totals))
        counts = np.zeros((len(lists), len(totals)), np.int64)
        counts[row[some], place[some] - begin] = n[some]
        return _shares(counts, totals)

    def told(sums):
        for lang, found in sums.items():
            a, b = np.indices(found.shape).reshape(2, -1)
            names = pa.array([lang]).take(pa.array(np.zeros(found.size, np.int64)))
            yield pa.RecordBatch.from_arrays([names, pa.array(a + first), pa.array(b + second), pa.array(found.ravel())], names=["lang", "a", "b", "value"])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                totals = sent.value[lang]
                own, others = (totals[x : x + tile] for x in (first, second))
                if not len(own) or not len(others):
                    continue
                at = np.flatnonzero(langs.indices.to_numpy() == code)
                found = sums.setdefault(lang, np.zeros((len(own), len(others)), np.int64))
                size = max(1, STEP_CELLS // len(others))
                for i in range(0, len(at), size):
                    lists = batch.column(1).take(pa.array(at[i : i + size]))
                    p, q = matrix(lists, first, own), matrix(lists, second, others)
                    for a in range(len(own)):
                        apart = p[:, a, None] - q
                        found[a] += (apart * apart // q).sum(axis=0)
            if sum(x.nbytes for x in sums.values()) > 8 * STEP_CELLS:
                yield from told(sums)
                sums.clear()
        yield from told(sums)

    return run


def divergence(df: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, slice_bytes: int = SLICE_BYTES, **columns) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the term distribution of each source is from others.

    A language keeps the terms of ``min_docs`` of its documents. A kept term with ``count`` occurrences in a group of
    ``N`` has ``p = 1 + floor(SCALE * (count + 1) / (N + V))``, V being the language's kept terms; a difference weighs
    ``floor((p - q)**2 / q)``. Part ``pair`` has, for each other source of the language, the sum over all kept terms (0
    without one); part ``term`` the terms that are more frequent in the group than in the language, up to ``top_terms``.
    Ranks go by value downwards, then by item.

    Null texts, languages and sources read as ``''``; groups without terms take part. Every row is a document, also if
    it is repeated. An empty table gives no rows; only the three columns named are read. Sums must fit in 64 bits, as
    they do with any counts that do.

    The pairs of sources are the result itself. All else is by term: each task adds up its own terms for
    ``TILE_SOURCES`` sources against as many; further sources take further passes over the kept terms. What is sent to
    the tasks is a number for each group.
    """
    counts = materialise(term_counts(df, slice_bytes=slice_bytes, **columns), "counts")
    source_col, lang_col = columns.get("source_col", "source"), columns.get("lang_col", "lang")
    empty = lambda c: F.coalesce(df[c].cast("string"), F.lit(""))
    groups = df.select(empty(lang_col).alias("lang"), empty(source_col).alias("source")).distinct()
    groups = groups.withColumn("place", F.expr("row_number() OVER (PARTITION BY lang ORDER BY source) - 1"))
    kept = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs)
    kept = materialise(kept.select("lang", "term", "lang_n"), "kept")
    # Both sides are large and a language holds most rows, but the key is the term: no key is hot.
    own = materialise(counts.drop("n_docs").join(kept, ["lang", "term"]), "own")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialise(
        groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source", "place", F.expr("coalesce(total, 0L) + v").alias("total"), F.expr("lang_total + v").alias("lang_total")
        ),
        "groups",
    )
    more = own.join(groups, ["lang", "source"])
    more = more.select("lang", "source", "term", F.expr(_share("n", "total")).alias("p"), F.expr(_share("lang_n", "lang_total")).alias("q"))
    more = more.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    terms = top_n_per_group(more, ["lang", "source"], order, top_terms).withColumn("part", F.lit("term"))
    pairs = _pairs(own, groups).withColumn("part", F.lit("pair"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*names).unionByName(terms.select(*names))


def _pairs(own: DataFrame, groups: DataFrame, tile: int = TILE_SOURCES) -> DataFrame:
    spark = groups.sparkSession
    told = groups.filter("total IS NOT NULL").orderBy("lang", "place").select("lang", "total").toPandas()
    totals = {lang: x["total"].to_numpy(np.int64) for lang, x in told.groupby("lang")}
    most = max(map(len, totals.values()), default=0)
    found = None
    if most > 1:
        sent = spark.sparkContext.broadcast(totals)
        placed = own.join(groups, ["lang", "source"]).groupBy("lang", "term").agg(F.collect_list(F.struct("place", "n")).alias("entries"))
        placed = placed.select("lang", "entries")
        if most > tile:
            placed = materialise(placed, "placed")
        tiles = range(0, most, tile)
        for first in tiles:
            for second in tiles:
                sums = placed.mapInArrow(_distances(sent, first, second, tile), "lang string, a long, b long, value long")
                found = sums if found is None else found.unionByName(sums)
        found = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one, other = groups.select("lang", "source", "place"), groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"))
    pairs = one.join(other, "lang").filter("place <> b")
    if found is None:
        pairs = pairs.withColumn("value", F.lit(0).cast("long"))
    else:
        pairs = pairs.withColumnRenamed("place", "a").join(found, ["lang", "a", "b"], "left").fillna(0, ["value"])
    return pairs.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)")).select(
        "lang", "source", "item", "value", "rank"
    )


def op13_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text
  FROM documents
),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS n_docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY lang, term HAVING sum(n_docs) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT lang, source, sum(n) AS total FROM c SEMI JOIN k USING (lang, term) GROUP BY lang, source),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(m.total, 0) + v.v) AS p,
         1 + {SCALE}::HUGEINT * (k.lang_n + 1) // (v.lang_total + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN m ON m.lang = g.lang AND m.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM x WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM o QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
