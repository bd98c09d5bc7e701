"""Hard-negative mining: exact integer inner products by Strassen's multiplication, and heaps that merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_n_per_group
from ..session import materialise, scratch_path
from .common import partitions, table

#: Rows with an id divisible by this are anchors; positives of an anchor, and negatives of a positive.
ANCHOR_STEP, POSITIVES, NEGATIVES = 100, 5, 5
#: A negative's score is from this percentage of the positive's score up to the positive's score itself.
LOW_PERCENT = 80
#: Anchors are sent to the tasks in parts of about so many bytes; all candidates are read once or twice for a part.
ANCHOR_BYTES = 16 << 20
#: Bytes of candidates in a task, anchors and candidates of a tile, and the side at which halving ends.
TASK_BYTES, TILE, LEAF = 32 << 20, 512, 16
#: Scores must stay below this in size, so that they, and four times them, are exact in 64 bits.
MOST = 1 << 60

_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices by seven products of halves, padded with zeros where a side is odd.

    All sums are taken modulo 2**64, so the result is exact whenever it fits, whatever the sums between are.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, p = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :p], b[:j, p:], b[j:, :p], b[j:, p:]
    m1 = strassen(a11 + a22, b11 + b22)
    m2 = strassen(a21 + a22, b11)
    m3 = strassen(a11, b12 - b22)
    m4 = strassen(a22, b21 - b11)
    m5 = strassen(a11 + a12, b22)
    m6 = strassen(a21 - a11, b11 + b12)
    m7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * p), np.int64)
    out[:i, :p] = m1 + m4 - m5 + m7
    out[:i, p:] = m3 + m5
    out[i:, :p] = m2 + m4
    out[i:, p:] = m1 - m2 + m3 + m6
    return out[:m, :n]


class Heaps:
    """The first ``k`` entries of many groups, by score downwards and then by id; the last of a group is its bar.

    What comes in later, be it a tile or the entries of other heaps, is merged with what is there.
    """

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), _NONE), np.zeros((n, k), np.int64)

    def offer(self, groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """A tile: a row of ``scores`` for each of the ``groups`` (all different), a column for each of the ``ids``."""
        k = self.scores.shape[1]
        scores = np.where(allowed, scores, _NONE)
        least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(groups), _NONE)
        least = np.maximum(least, self.scores[groups, -1])
        row, column = np.nonzero((scores >= least[:, None]) & (scores > _NONE))  # ties with the bar may come first by id
        self.merge(groups[row], scores[row, column], ids[column])

    def merge(self, groups: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(groups)
        k = self.scores.shape[1]
        groups = np.concatenate([groups, np.repeat(touched, k)])
        scores = np.concatenate([scores, self.scores[touched].ravel()])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((ids, ~scores, groups))  # ~x falls as x rises, for the least number too
        groups, scores, ids = groups[order], scores[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        place = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))
        some = place < k
        self.scores[groups[some], place[some]] = scores[some]
        self.ids[groups[some], place[some]] = ids[some]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, place = np.nonzero(self.scores > _NONE)
        return group, self.scores[group, place], self.ids[group, place]


def vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256
) -> DataFrame:
    """``vec_id, label, x`` of the rows that take part: components as ``floor(scale * x)``, with x a double.

    Rows with a null id, label or vector, or with a component that is null, not a number or infinite, take no part.
    """
    x = F.transform(df[vector_col], lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[label_col].cast("long").alias("label"), x.alias("x"), good.alias("good"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND good")
    return rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("x"))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of ``width``; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _tiles(anchors: dict, candidates: pa.RecordBatch, same_label: bool):
    """Scores of anchors (their rows) and candidates (their ids), for pairs of one label or of different labels."""
    ids, labels = (candidates.column(i).to_numpy() for i in (0, 1))
    x = _matrix(candidates.column(2), anchors["x"].shape[1])
    highest = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    if x.shape[1] * highest(x) * highest(anchors["x"]) >= MOST:
        raise ValueError("scores of these vectors don't fit in 64 bits")
    for label in np.unique(labels):
        own = np.flatnonzero((anchors["label"] == label) == same_label)
        at = np.flatnonzero(labels == label)
        for i in range(0, len(own), TILE):
            rows = own[i : i + TILE]
            a = anchors["x"][rows]
            for j in range(0, len(at), 2 * TILE):
                some = at[j : j + 2 * TILE]
                yield rows, ids[some], strassen(a, x[some].T)


_POSITIVE = "anchor long, score long, other long"


def _positives(sent):
    """In a task: each anchor's best rows of its own label."""

    def run(batches):
        anchors = sent.value
        heaps = Heaps(len(anchors["id"]), POSITIVES)
        for batch in batches:
            for rows, ids, scores in _tiles(anchors, batch, True):
                heaps.offer(rows, scores, ids, ids != anchors["id"][rows][:, None])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in heaps.entries()], names=["anchor", "score", "other"])

    return run


def _negatives(sent):
    """In a task: for each anchor and positive, the best rows of other labels inside the positive's window."""

    def run(batches):
        anchors = sent.value
        high = anchors["high"]  # scores of positives, a column for each rank
        low = -((-LOW_PERCENT // 20 * high) // (100 // 20))  # the least whole number not under 80 %
        heaps = Heaps(high.size, NEGATIVES)
        for batch in batches:
            for rows, ids, scores in _tiles(anchors, batch, False):
                for place in range(high.shape[1]):
                    some = anchors["given"][rows, place]
                    own, tile = rows[some], scores[some]
                    inside = (tile <= high[own, place][:, None]) & (tile >= low[own, place][:, None])
                    if inside.any():
                        heaps.offer(own * high.shape[1] + place, tile, ids, inside)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in heaps.entries()], names=["anchor", "score", "other"])

    return run


def _best(found: DataFrame, n: int) -> DataFrame:
    return top_n_per_group(found, ["anchor"], [F.desc("score"), F.asc("other")], n)


def mine(rows: DataFrame, anchor_step: int = ANCHOR_STEP, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """Hard negatives of ``vectors``: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` and
    ``positive_rank``.

    Anchors are rows whose id is divisible by ``anchor_step``. A row's score is its integer inner product with the
    anchor; higher scores come first, ties by smaller id. An anchor's positives are its first ``POSITIVES`` rows of the
    same label with another id; a positive's negatives are the first ``NEGATIVES`` rows of other labels whose score is
    80 % of the positive's score at least and no higher than it (so none under a positive with a negative score).

    Repeated rows are rows of their own and take ranks of their own; an anchor that is repeated is one anchor. Vectors
    of different lengths are compared as if the shorter ended in zeros; an empty one has the score 0. Scores that could
    pass 2**60 are an error. An empty table, or one without anchors, gives no rows.

    Anchors, a stated share of the rows, are sent to the tasks in parts of bounded size; each task multiplies tiles of
    them with its candidates and gives back its heaps, which are merged by anchor. A part reads the candidates twice,
    once for pairs of one label and once for pairs of two, so every pair is multiplied once.
    """
    spark = rows.sparkSession
    told = rows.agg(
        F.count(F.lit(1)), F.sum(F.size("x")), F.max(F.size("x")), F.count_if(F.expr(f"vec_id % {anchor_step} = 0"))
    ).first()
    n, numbers, width, n_anchors = told[0], told[1] or 0, max(told[2] or 0, 1), told[3]
    rows = materialise(rows.repartition(max(partitions(spark), 8 * numbers // TASK_BYTES + 1)), "vectors")
    anchors = rows.filter(F.expr(f"vec_id % {anchor_step} = 0")).distinct()
    parts = 8 * width * n_anchors // anchor_bytes + 1
    path = scratch_path(spark, "negatives")
    for part in range(parts):
        own = anchors.filter(F.expr(f"pmod(xxhash64(vec_id, x), {parts}) = {part}")).orderBy("vec_id", "label", "x").toArrow().combine_chunks()
        if not own.num_rows and part:
            continue
        sent = {"id": own.column(0).to_numpy(), "label": own.column(1).to_numpy()}
        lists = own.column(2).combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.int64()))
        sent["x"] = _matrix(lists, width)
        near = _best(rows.mapInArrow(_positives(spark.sparkContext.broadcast(sent)), _POSITIVE), POSITIVES).toPandas()
        at, place = near["anchor"].to_numpy(np.int64), near["rank"].to_numpy(np.int64) - 1
        shape = (own.num_rows, POSITIVES)
        sent |= {"high": np.zeros(shape, np.int64), "given": np.zeros(shape, bool)}
        sent["high"][at, place], sent["given"][at, place] = near["score"], True
        found = _best(rows.mapInArrow(_negatives(spark.sparkContext.broadcast(sent)), _POSITIVE), NEGATIVES)
        # The part's anchors and positives, a row for each window, as a table to join with: of bounded size as well.
        windows = pa.table(
            {
                "window": pa.array(at * POSITIVES + place, pa.int64()),
                "anchor_id": pa.array(sent["id"][at], pa.int64()),
                "positive_id": pa.array(near["other"].to_numpy(np.int64), pa.int64()),
                "positive_score": pa.array(near["score"].to_numpy(np.int64), pa.int64()),
                "positive_rank": pa.array((place + 1).astype(np.int32)),
            }
        )
        windows = spark.createDataFrame(windows)
        out = found.join(windows, F.col("anchor") == F.col("window"))
        out = out.select(
            "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"), "positive_rank",
        )
        out.write.parquet(f"{path}/part={part}")
    return spark.read.schema(out.schema).parquet(path).select(*out.columns)


def op11_negatives(spark, sf_dir):
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return mine(rows.withColumn("label", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")))


OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % {ANCHOR_STEP} = 0
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
  FROM s WHERE same QUALIFY positive_rank <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score,
       CAST(positive_rank AS INTEGER) AS positive_rank
FROM (
  SELECT p.anchor_id, positive_id, positive_rank, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE {LOW_PERCENT} * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
WHERE rank <= {NEGATIVES}
"""
