"""URL filters: rules over host and path, and exact membership in a list by a cascade of Bloom filters."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import counted, materialise
from .common import LOWER, UPPER, lower_ascii, table

#: (host and path, verdict). A rule fits its host and all subdomains of it.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Words that put a host on the list of the query; a host is listed if one of its labels has one as a part between hyphens.
LISTED_WORDS = ("bet", "bets", "casino", "loan", "loans", "pills", "poker", "porn", "win", "xxx")
#: A page whose html has fewer characters outside its tags is on the list as well: there is nothing to read.
THIN_CHARS = 600
#: Filters of all levels of a cascade that may be sent to an executor; larger universes are split by the keys' hashes.
MAX_FILTER_BYTES = 32 << 20
LEVELS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, shape, i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


# --- The cascade -----------------------------------------------------------------------------------------------------


def hashed(key: Column) -> Column:
    """128 bits of a key, as two longs."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


@dataclass
class Level:
    """One Bloom filter: ``bits`` in words of 64, ``hashes`` places for a key."""

    number: int
    size: int
    hashes: int
    words: np.ndarray | None = None

    @classmethod
    def of(cls, number: int, keys: int, rate: float) -> Level:
        hashes = max(1, round(-math.log2(rate)))
        return cls(number, 64 * math.ceil(max(64, keys * hashes / math.log(2)) / 64), hashes)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """``keys x hashes`` places. Each level stirs the hashes anew, so that levels err independently."""
        a, b = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
        a = (a ^ np.uint64((self.number + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(31)
        b = ((b + np.uint64(self.number)) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        mixed = a[:, None] + np.arange(self.hashes, dtype=np.uint64) * b[:, None]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(11)) % np.uint64(self.size)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.places(h1, h2)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("h1").to_numpy(), batch.column("h2").to_numpy()


def _build(keys: DataFrame, level: Level) -> Level:
    """Set the places of ``keys``: each task gives its words of bits, these are united, and only they come here."""

    def bits(batches):
        for batch in batches:
            at = np.unique(level.places(*_hashes(batch)).ravel())
            word = (at >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, int)
            united = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(word) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(united.view(np.int64))], names=["word", "bits"])

    united = keys.mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = united.toArrow()  # at most level.size / 64 rows, checked by the caller
    level.words = np.zeros(level.size // 64, np.uint64)
    level.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return level


def _held(keys: DataFrame, level: Level) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(sent.value.holds(*_hashes(batch))))

    return keys.mapInArrow(keep, keys.schema)


def cascade_parts(n: int, others: int, max_bytes: int = MAX_FILTER_BYTES) -> int:
    """How many cascades ``n`` listed and ``others`` not listed keys need, so that each takes ``max_bytes`` at most.

    Behind the first level, levels hold about 0.7 n keys, half of n, half of 0.7 n and so on, one hash each.
    """
    if not n:
        return 1
    first = Level.of(0, n, _first_rate(n, others))
    return math.ceil((1.1 * (first.size + 2.5 * n / math.log(2)) + 64 * LEVELS) / 8 / max_bytes)


def _first_rate(n: int, others: int) -> float:
    return min(0.5, math.sqrt(0.5) * n / max(others, 1))


def build_cascade(keys: DataFrame) -> list[Level]:
    """A cascade for ``h1, h2, listed``, the whole universe of keys (see ``hashed``), each once.

    The first level holds the listed keys; the second the other keys that the first holds by mistake; the third the
    listed keys that the second holds by mistake; and so on until a level makes no mistake. So each key of the universe
    is told exactly. No listed key gives no level.
    """
    inside, outside = keys.filter("listed").select("h1", "h2"), keys.filter(~F.col("listed")).select("h1", "h2")
    levels: list[Level] = []
    n, others = inside.count(), outside.count()
    while n:
        if len(levels) == LEVELS:
            raise ValueError("two keys share all their hash bits")
        level = Level.of(len(levels), n, 0.5 if levels else _first_rate(n, others))
        levels.append(_build(inside, level))
        mistaken, found = counted(_held(outside, level), "mistaken")
        inside, outside, n = mistaken, inside, found
    return levels


def is_listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The last level that holds a key, of those before the first that does not, tells: it holds listed keys if its
    number is even, and others if it is odd."""
    listed = np.zeros(len(h1), bool)
    left = np.arange(len(h1))
    for level in levels:
        left = left[level.holds(h1[left], h2[left])]
        listed[left] = level.number % 2 == 0
    return listed


def _told_by(df: DataFrame, key: Column, levels: list[Level], name: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(levels)  # bounded by ``cascade_parts``

    @F.pandas_udf("boolean")
    def member(h):
        import pandas as pd

        return pd.Series(is_listed(sent.value, h["h1"].to_numpy(), h["h2"].to_numpy()), index=h.index)

    return df.withColumn(name, key.isNotNull() & member(hashed(F.coalesce(key, F.lit("")))))


def with_listed(df: DataFrame, key: Column, listed_keys: DataFrame, name: str = "listed", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``df`` and a boolean: is ``key`` among the keys (a single column) of ``listed_keys``? Exact, by a cascade over
    all keys of ``df``. Null is never listed; an empty ``df`` or list is fine.

    If one cascade would take more than ``max_bytes``, the universe is split by the keys' hashes into as many parts as
    it takes; each has a cascade of its own, which only the rows of that part get.
    """
    column = listed_keys.columns[0]
    listed = listed_keys.select(F.col(column).alias("_listed_key")).filter("_listed_key IS NOT NULL")
    keys = df.select(hashed(key).alias("h"), F.lit(False).alias("listed")).filter(key.isNotNull())
    marked = keys.union(listed.select(hashed(F.col("_listed_key")), F.lit(True)))
    once = marked.groupBy(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")).agg(F.max("listed").alias("listed"))
    universe, total = counted(once, "keys")
    n = universe.filter("listed").count()
    parts = cascade_parts(n, total - n, max_bytes)
    if parts == 1:
        return _told_by(df, key, build_cascade(universe), name)
    own = F.coalesce(F.pmod(hashed(key)["h1"], F.lit(parts)), F.lit(0))
    placed = materialise(df.withColumn("_cascade_part", F.when(key.isNull(), 0).otherwise(own).cast("int")), "placed", "_cascade_part")
    out = None
    for part in range(parts):
        levels = build_cascade(universe.filter(F.expr(f"pmod(h1, {parts}) = {part}")))
        told = _told_by(placed.filter(F.col("_cascade_part") == part).drop("_cascade_part"), key, levels, name)
        out = told if out is None else out.unionByName(told)
    return out


def _has_listed_word(host: Column) -> Column:
    return host.rlike(rf"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)")


def judge_urls(pages: DataFrame, listed_keys: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, listed, verdict`` of every row of ``pages``.

    The verdict is that of the longest rule that fits; else block if ``host || path`` is among ``listed_keys``, else
    allow. Null urls and urls without ``://`` have an empty host and path, fit no rule, and are judged like others.
    Rows that are repeated are judged each; an empty table gives none; only the two columns named are read.
    """
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("_url"))
    host, path = url_parts(F.col("_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    told = with_listed(rows, F.concat("host", "path"), listed_keys)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(says, F.when(F.col("listed"), F.lit("block")).otherwise("allow"))
    return told.select("page_id", "host", "path", rule.alias("rule"), "listed", verdict.alias("verdict"))


def op4_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host, path = url_parts(F.col("url"))
    thin = F.length(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "")) < THIN_CHARS
    listed = pages.select(host.alias("host"), path.alias("path"), thin.alias("thin")).filter(_has_listed_word(F.col("host")) | F.col("thin"))
    listed = listed.select(F.concat("host", "path").alias("key"))
    return judge_urls(pages, listed)


def _rules_sql(column: int) -> str:
    cases = []
    for rule in sorted(RULES, key=lambda r: -len(r[0])):
        name, slash, rest = rule[0].partition("/")
        cases.append(f"WHEN (host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '{slash}{rest}') THEN '{rule[column]}'")
    return "CASE " + " ".join(cases) + " END"


OP4_SQL = f"""
WITH p AS (
  SELECT page_id, length(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g')) < {THIN_CHARS} AS thin,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
),
k AS (SELECT DISTINCT host || path AS key FROM p WHERE thin OR regexp_matches(host, '(^|[.-])({"|".join(LISTED_WORDS)})([.-]|$)')),
l AS (SELECT *, host || path IN (SELECT key FROM k) AS listed FROM p)
SELECT page_id, host, path, {_rules_sql(0)} AS rule, listed,
       coalesce({_rules_sql(1)}, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM l
"""
