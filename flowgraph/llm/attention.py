"""Scores of texts: smoothed counts of words, and a causal self-attention model over subword ids, trained here in numpy.

A text is read as its words, each encoded by itself behind one blank, and an end. The model's softmax has two levels: the
ids that are most frequent in all training texts stand in classes of equal size, all other ids in one class of their own,
inside which their smoothed counts hold. Its biases begin as the logarithms of these counts, so before any step of
training the model is that of single ids, over all training texts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import table
from .tokens import Encoder, encoder, steps, tokenizer_path

#: Documents whose crc32 (of the id as text) leaves this remainder are held out.
FOLDS, HELD_OUT = 10, 0
#: Added to every count.
SMOOTHING = 0.1
#: Words up to so many bytes, and so many of the most frequent ones, are sent to the tasks; all others are joined.
TOP_WORDS, TOP_BYTES = 1 << 18, 64
#: Classes of ids and ids in each; context; ids that a window scores, except the first of a text, which scores all.
CLASSES, CLASS_IDS, WINDOW, STRIDE = 63, 64, 24, 20
#: Size of a hidden state and of the layer behind attention.
SIZE, LAYER = 16, 32
#: The first round of training takes one in so many training documents (a power of two), each later one as many as all
#: before it, until all are taken; least windows of a task, windows of a step, the first round's rate, and what it is
#: multiplied with in the next.
SHARE, TASK_WINDOWS, STEP_WINDOWS, RATE, SLOWER = 16, 20_000, 128, 0.008, 0.375
#: Bytes of words (with their places) that are counted at a time.
COUNT_BYTES = 16 << 20
#: Windows that are scored at a time, numbers of a block of the parameters, and tasks whose blocks meet first.
BATCH_WINDOWS, BLOCK, MEET = 1024, 1 << 14, 32

TOP_IDS = CLASSES * CLASS_IDS
_RARE, _BEGIN = TOP_IDS, TOP_IDS + 1
_NONE = -1

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, np.where((_BYTES >= 9) & (_BYTES <= 13), 32, _BYTES)).astype(np.uint8)


# --- Words -----------------------------------------------------------------------------------------------------------


def units(texts: pa.Array) -> pa.LargeListArray:
    """The words of each text, A-Z in lower case, each with one blank before it; made in the texts' bytes."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    starts = ends[:-1] - ends[0] + np.arange(len(texts))  # with a blank more before each text
    whole = np.full(len(data) + len(texts), 32, np.uint8)
    inside = np.ones(len(whole), bool)
    inside[starts] = False
    whole[inside] = data
    blank = whole == 32
    before = blank & np.append(~blank[1:], False)  # the last blank before each word
    kept = before | ~blank
    whole = whole[kept]
    offsets = np.append(np.flatnonzero(before[kept]), len(whole)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
    lists = np.append(np.searchsorted(np.flatnonzero(before), starts), len(words))  # no number for each byte
    return pa.LargeListArray.from_arrays(pa.array(lists, pa.int64()), words)


def training(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, held_out`` and ``learn`` of each row; a null id is neither held out nor learnt from."""
    rest = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    return rows.withColumns({"held_out": F.coalesce(rest == HELD_OUT, F.lit(False)), "learn": F.coalesce(rest != HELD_OUT, F.lit(False))})


def word_counts(rows: DataFrame) -> DataFrame:
    """``unit, c``: how often each word occurs; combined over ``COUNT_BYTES``, then on the map side.

    Texts are cut into words a step at a time, as the cutting takes several times a text's size.
    """

    def counted(words: list[pa.Array]) -> pa.RecordBatch:
        found = pa.chunked_array(words, pa.large_string()).value_counts()
        return pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["unit", "c"])

    def run(batches):
        held, size = [], 0
        for _, texts in steps(batches):
            held.append(units(texts).flatten())
            size += held[-1].nbytes
            if size >= COUNT_BYTES:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    found = rows.select("doc_id", "text").mapInArrow(run, "unit string, c long")
    return found.groupBy("unit").agg(F.sum("c").alias("c"))


def id_counts(counts: DataFrame, path: str) -> np.ndarray:
    """How often each subword id occurs in the counted words; as many numbers as the vocabulary has ids."""
    size = encoder(path).tokenizer.get_vocab_size()

    def run(batches):
        for batch in batches:
            words, times = batch.column(0).cast(pa.large_string()), batch.column(1).to_numpy()
            ids, ends = _encoded(encoder(path), pa.LargeListArray.from_arrays(pa.array(range(len(words) + 1), pa.int64()), words))
            found = np.bincount(ids, np.repeat(times, np.diff(ends, prepend=0)), size).astype(np.int64)
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["id", "n"])

    found = counts.select("unit", "c").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


def _encoded(known: Encoder, lists: pa.LargeListArray) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of lists of words, in one array, and the end of each list in it."""
    if not len(lists.flatten()):
        return np.zeros(0, np.int64), np.zeros(len(lists), np.int64)
    flat, ends = known.rows(lists)
    return flat.astype(np.int64), ends


# --- The model -------------------------------------------------------------------------------------------------------


class Ids(NamedTuple):
    """Subword ids as the model's ids, by their counts."""

    place: np.ndarray  #: the model's id of each subword id; the end of a text is the subword id past the last
    rare_log: np.ndarray  #: log-probability of each subword id inside the class of all rare ones
    counts: np.ndarray  #: of the model's ids

    @classmethod
    def of(cls, counts: np.ndarray) -> Ids:
        order = np.lexsort((np.arange(len(counts)), -counts))
        place = np.full(len(counts), _RARE)
        place[order[:TOP_IDS]] = np.arange(min(TOP_IDS, len(order)))
        rare = place == _RARE
        chance = (counts + SMOOTHING) / (counts[rare].sum() + SMOOTHING * max(rare.sum(), 1))
        own = np.bincount(place, counts, TOP_IDS + 1)
        return cls(place, np.where(rare, np.log(chance), 0.0), own)

    def sequences(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The model's ids of texts, each with two begins before it and its end behind, in one array; the bounds of
        the texts in it, and the part of each text's log-probability that rare ids have inside their class."""
        n = len(ends)
        lengths = np.diff(ends, prepend=0)
        bounds = np.concatenate([[0], np.cumsum(lengths + 3)])
        out = np.full(bounds[-1], _BEGIN, np.int64)
        out[np.arange(len(ids)) + np.repeat(3 * np.arange(n) + 2, lengths)] = self.place[ids]
        out[bounds[1:] - 1] = self.place[-1]
        inside = np.bincount(np.repeat(np.arange(n), lengths), self.rare_log[ids], n) + self.rare_log[-1]
        return out, bounds, inside


def windows(sequence: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts: a row of ids for each (two before those it predicts; ``_NONE`` past the end),
    the text of each, and which predictions it counts for. Each id of a text counts once."""
    n = np.diff(bounds) - 2  # predictions of each text
    number = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(n)), number)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    at = (bounds[:-1][text] + turn * STRIDE)[:, None] + np.arange(WINDOW + 2)
    inside = at < bounds[1:][text][:, None]
    rows = np.where(inside, sequence[np.minimum(at, len(sequence) - 1)], _NONE)
    counts = inside[:, 2:] & ((turn == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE))
    return rows, text, counts


_SHAPES = {
    "now": (TOP_IDS + 2, SIZE), "before": (TOP_IDS + 2, SIZE), "place": (WINDOW, SIZE),
    "query": (SIZE, SIZE), "key": (SIZE, SIZE), "value": (SIZE, SIZE), "back": (SIZE, SIZE),
    "wide": (SIZE, LAYER), "wide_bias": (LAYER,), "narrow": (LAYER, SIZE),
    "classes": (SIZE, CLASSES + 1), "class_bias": (CLASSES + 1,),
    "inner": (CLASSES, SIZE, CLASS_IDS), "inner_bias": (CLASSES, CLASS_IDS),
}
N_NUMBERS = sum(int(np.prod(s)) for s in _SHAPES.values())
_BACK = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def start(counts: np.ndarray, seed: int = 1) -> np.ndarray:
    """Parameters (one array) before training, from the counts of the model's ids."""
    flat = np.random.default_rng(seed).normal(0, 0.1, N_NUMBERS).astype(np.float32)
    p = _views(flat)
    smooth = counts + SMOOTHING
    top = smooth[:TOP_IDS].reshape(CLASSES, CLASS_IDS)
    p["inner_bias"][:] = np.log(top / top.sum(axis=1, keepdims=True))
    p["class_bias"][:] = np.log(np.append(top.sum(axis=1), smooth[_RARE]) / smooth.sum())
    for name in ("classes", "inner", "wide_bias", "back", "narrow"):
        p[name] *= 0.1
    return flat


def _softmax(x: np.ndarray, exact: bool) -> np.ndarray:
    """Shares of ``exp`` of each row; see ``_states`` for ``exact``."""
    if exact:
        x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[-1], x.dtype))[:, None]
    return x


def _sum(x: np.ndarray) -> np.ndarray:
    """Sums of the columns."""
    return np.ones(len(x), x.dtype) @ x


def _states(p: dict[str, np.ndarray], rows: np.ndarray, exact: bool):
    """Hidden states of windows (rows times WINDOW, SIZE), and what the way back needs.

    Weights of attention are taken as they come, without their largest being taken off first, unless ``exact``; if
    they don't fit into 32 bits, sums are infinite or no numbers, and the caller sees it in its result.
    """
    n = len(rows)
    shown = np.maximum(rows, 0)  # past the end: no matter what, nothing looks ahead
    e = np.take(p["now"], shown[:, 1:-1].ravel(), axis=0)
    e += np.take(p["before"], shown[:, :-2].ravel(), axis=0)
    e.reshape(n, WINDOW, SIZE)[:] += p["place"]
    all_ = e @ np.concatenate([p["query"] * e.dtype.type(SIZE**-0.5), p["key"], p["value"]], axis=1)
    q, k, v = (np.ascontiguousarray(all_[:, i * SIZE : (i + 1) * SIZE]).reshape(n, WINDOW, SIZE) for i in range(3))
    a = q @ k.transpose(0, 2, 1)
    if exact:
        a = np.where(_BACK > 0, a, -np.inf)
        a -= a.max(axis=-1, keepdims=True)
    np.exp(a, out=a)
    a *= _BACK
    total = a @ np.ones(WINDOW, a.dtype)
    o = (a @ v) / total[..., None]
    o = o.reshape(-1, SIZE)
    h = e + o @ p["back"]
    u = h @ p["wide"]
    u += p["wide_bias"]
    np.maximum(u, 0, out=u)
    return h + u @ p["narrow"], (shown, e, q, k, v, a, total, o, h, u)


def _by_class(targets: np.ndarray):
    """Order of targets by class, and for each class that has any: the class and its range in that order."""
    kind = targets // CLASS_IDS
    order = np.argsort(kind.astype(np.int8), kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=CLASSES + 1)).tolist()
    return order, [(c, ends[c - 1] if c else 0, ends[c]) for c in range(CLASSES) if ends[c] > (ends[c - 1] if c else 0)]


def _log_share(x: np.ndarray, own: np.ndarray, exact: bool) -> np.ndarray:
    """Logarithm of the own entry's share among ``exp`` of each row; see ``_states`` for ``exact``."""
    if exact:
        x = x - x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return np.log(x[np.arange(len(own)), own] / (x @ np.ones(x.shape[1], x.dtype)))


def _predictions(p: dict[str, np.ndarray], rows: np.ndarray, counted: np.ndarray, exact: bool) -> np.ndarray:
    """Log-probability of each counted prediction, in the order of ``counted``."""
    h = _states(p, rows, exact)[0][counted.ravel()]
    targets = rows[:, 2:][counted]
    x = h @ p["classes"]
    x += p["class_bias"]
    found = _log_share(x, targets // CLASS_IDS, exact).astype(np.float64)
    order, ranges = _by_class(targets)
    h, inner = h[order], targets[order] % CLASS_IDS
    more = np.zeros(len(order))
    for c, a, b in ranges:
        x = h[a:b] @ p["inner"][c]
        x += p["inner_bias"][c]
        more[a:b] = _log_share(x, inner[a:b], exact)
    found[order] += more
    return found


def log_probs(flat: np.ndarray, rows: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Sum of the log-probabilities (natural) of the counted predictions of each window."""
    p = _views(flat)
    out = np.zeros(len(rows))
    for i in range(0, len(rows), BATCH_WINDOWS):
        part, some = rows[i : i + BATCH_WINDOWS], counted[i : i + BATCH_WINDOWS]
        with np.errstate(all="ignore"):
            found = _predictions(p, part, some, False)
        if not np.isfinite(found).all():
            found = _predictions(p, part, some, True)
        out[i : i + len(part)] = np.bincount(np.nonzero(some)[0], found, len(part))
    return out


def _add_rows(to: np.ndarray, at: np.ndarray, what: np.ndarray) -> None:
    """Add rows to those at the places ``at``, which may recur."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    to[at[first]] += np.add.reduceat(what[order], first, axis=0)


def gradient(flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the mean negative log-probability of all predictions in windows, and that mean."""
    with np.errstate(all="ignore"):
        slope, loss = _gradient(flat, rows, False)
    return (slope, loss) if np.isfinite(loss) and np.isfinite(slope).all() else _gradient(flat, rows, True)


def _gradient(flat: np.ndarray, rows: np.ndarray, exact: bool) -> tuple[np.ndarray, float]:
    p, slope = _views(flat), np.zeros_like(flat)
    g = _views(slope)
    states, (shown, e, q, k, v, a, total, o, h, u) = _states(p, rows, exact)
    some = (rows[:, 2:] >= 0).ravel()
    x, targets = states[some], rows[:, 2:].ravel()[some]
    n = len(targets)
    chance = x @ p["classes"]
    chance += p["class_bias"]
    chance = _softmax(chance, exact)
    own = (np.arange(n), targets // CLASS_IDS)
    loss = -np.log(chance[own] + 1e-30).sum(dtype=np.float64)
    chance[own] -= 1
    g["classes"][:], g["class_bias"][:] = x.T @ chance, _sum(chance)
    back = chance @ p["classes"].T
    order, ranges = _by_class(targets)
    ordered, inner, more = x[order], targets[order] % CLASS_IDS, np.zeros_like(x)
    for c, begin, end in ranges:
        mine = ordered[begin:end]
        chance = mine @ p["inner"][c]
        chance += p["inner_bias"][c]
        chance = _softmax(chance, exact)
        own = (np.arange(end - begin), inner[begin:end])
        loss -= np.log(chance[own] + 1e-30).sum(dtype=np.float64)
        chance[own] -= 1
        g["inner"][c], g["inner_bias"][c] = mine.T @ chance, _sum(chance)
        more[begin:end] = chance @ p["inner"][c].T
    back[order] += more
    d = np.zeros_like(states)
    d[some] = back
    g["narrow"][:] = u.T @ d
    du = (d @ p["narrow"].T) * (u > 0)
    g["wide"][:], g["wide_bias"][:] = h.T @ du, _sum(du)
    dh = d + du @ p["wide"].T
    g["back"][:] = o.T @ dh
    deep = lambda m: m.reshape(len(rows), WINDOW, SIZE)
    do = deep(dh @ p["back"].T)
    a /= total[..., None]
    dv, da = a.transpose(0, 2, 1) @ do, do @ v.transpose(0, 2, 1)
    da = a * (da - (da * a).sum(axis=-1, keepdims=True))
    scale = e.dtype.type(SIZE**-0.5)
    dq, dk = da @ k * scale, da.transpose(0, 2, 1) @ q  # q holds the scale already
    de = dh
    for name, part in (("query", dq), ("key", dk), ("value", dv)):
        part = part.reshape(-1, SIZE)
        g[name][:] = e.T @ part
        de = de + part @ p[name].T
    g["place"][:] = deep(de).sum(axis=0)
    _add_rows(g["now"], shown[:, 1:-1].ravel(), de)
    _add_rows(g["before"], shown[:, :-2].ravel(), de)
    slope /= n
    return slope, loss / n


def descend(flat: np.ndarray, batches, rate: float, seed: int) -> tuple[np.ndarray, int]:
    """Parameters after a pass over batches of windows, by Adam, and the number of windows; the batches are shuffled."""
    flat, rng = flat.copy(), np.random.default_rng(seed)
    mean, square, by, step, seen = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat), 0, 0
    for rows in batches:
        rows = rows[rng.permutation(len(rows))]
        seen += len(rows)
        for i in range(0, len(rows), STEP_WINDOWS):
            slope, _ = gradient(flat, rows[i : i + STEP_WINDOWS])
            step += 1
            mean *= np.float32(0.9)
            square *= np.float32(0.99)
            square += np.multiply(np.multiply(slope, slope, out=by), np.float32(0.01), out=by)
            mean += np.multiply(slope, np.float32(0.1), out=by)
            scale = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            np.sqrt(square, out=by)
            by += np.float32(1e-8)
            np.divide(mean, by, out=by)
            by *= np.float32(scale)
            flat -= by
    return flat, seen


# --- On Spark --------------------------------------------------------------------------------------------------------


def rounds() -> list[tuple[int, int]]:
    """For each round the range of hashes below ``SHARE`` whose documents it takes; together they are all."""
    ends = [1 << i for i in range(SHARE.bit_length())]
    return [*zip([0, *ends], ends, strict=False)]


def train(rows: DataFrame, ids: Ids, path: str) -> np.ndarray:
    """The model's parameters, trained on every learnt document once.

    Rounds share out the documents by hash. In each round every task starts from the same parameters and makes one pass
    over the windows of its own documents, cut as they are read; the parameters are then averaged, weighted by windows,
    first those of ``MEET`` tasks, then all. So the work grows with the input in all tasks alike, and only parameters,
    of fixed size, go to and from the driver. Early rounds are short, so that tasks part little before they first meet.
    """
    spark = rows.sparkSession
    sent_ids = spark.sparkContext.broadcast(ids)  # as large as the vocabulary
    learnt = rows.filter("learn").select("doc_id", "text", F.expr(f"pmod(xxhash64(doc_id, text), {SHARE})").alias("turn"))
    flat = start(ids.counts)
    for number, (first, last) in enumerate(rounds()):
        sent = spark.sparkContext.broadcast(flat)
        rate = RATE * SLOWER**number

        def run(batches, sent=sent, rate=rate, number=number):
            task = TaskContext.get().partitionId()
            cut = (windows(*sent_ids.value.sequences(*_encoded(encoder(path), units(texts)))[:2])[0] for _, texts in steps(batches))
            ended, seen = descend(sent.value, cut, rate, 1000 * number + task)
            if seen:
                blocks = [(ended[i : i + BLOCK].astype(np.float64) * seen).tolist() for i in range(0, len(ended), BLOCK)]
                names = ["block", "task", "weight", "numbers"]
                columns = [range(len(blocks)), [task] * len(blocks), [float(seen)] * len(blocks), blocks]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        share = (last - first) / SHARE
        tasks = int(ids.counts.sum() * share / STRIDE) // TASK_WINDOWS + 1  # fewer than the table's only if those are short
        chosen = learnt.filter((F.col("turn") >= first) & (F.col("turn") < last)).select("doc_id", "text").coalesce(tasks)
        kinds = "block long, task long, weight double, numbers array<double>"
        ends = chosen.mapInArrow(run, kinds)
        ends = ends.groupBy("block", F.expr(f"task div {MEET}")).applyInArrow(_together, kinds).groupBy("block").applyInArrow(_together, kinds)
        told = ends.toArrow().sort_by("block")
        if told.num_rows:
            flat = np.concatenate([np.array(x) / w for x, w in zip(told.column("numbers").to_pylist(), told.column("weight").to_pylist(), strict=True)])
            flat = flat.astype(np.float32)
    return flat


def _together(found: pa.Table) -> pa.Table:
    """Weighted parameters of a block, added up in the order of tasks."""
    found = found.sort_by("task")
    total = sum((np.array(x.values) for x in found.column("numbers")), np.zeros(1))
    first = found.slice(0, 1).select(["block", "task"])
    return first.append_column("weight", pa.array([float(pc.sum(found.column("weight")).as_py())])).append_column("numbers", pa.array([total.tolist()]))


def _top_words(counts: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """The most frequent short words, at most ``TOP_WORDS``, and their counts: all from a count on that a table of
    rounded counts shows to be few enough."""
    short = counts.filter(F.octet_length("unit") <= TOP_BYTES).withColumn("size", F.expr("CAST(floor(8 * log2(c)) AS INT)"))
    total, least = 0, None
    for r in sorted(short.groupBy("size").count().collect(), reverse=True):
        total += r["count"]
        if total > TOP_WORDS:
            break
        least = r["size"]
    if least is None:
        return pa.array([], pa.large_string()), np.zeros(0)
    found = short.filter(F.col("size") >= least).select("unit", "c").toArrow()
    return found.column("unit").combine_chunks().cast(pa.large_string()), found.column("c").to_numpy()


def _scored(sent, path: str):
    """In a task: for each text a row of its measures by the words sent, and rows of the words that were not sent."""
    names = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "unit", "times"]

    def run(batches):
        words, logs, end_log, end_known, ids, flat = sent.value
        for rows, texts in steps(batches):
            key, doc_id, held_out = rows.flatten()
            lists = units(texts)
            coded = lists.flatten().dictionary_encode()
            place = pc.index_in(coded.dictionary, value_set=words)
            own = np.append(logs, 0.0)[place.fill_null(len(words)).to_numpy()]  # by word of this batch
            known = place.is_valid().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).to_numpy()
            text = np.repeat(np.arange(len(texts)), sizes)
            code = coded.indices.to_numpy().astype(np.int64)
            base = np.bincount(text, own[code], len(texts)) + end_log
            n_known = np.bincount(text, known[code], len(texts)).astype(np.int64) + end_known
            sequence, bounds, inside = ids.sequences(*_encoded(encoder(path), lists))
            score = inside
            for first in range(0, len(texts), 64):  # windows of some texts at a time
                some = bounds[first : first + 65]
                cut, owner, counted = windows(sequence[some[0] : some[-1]], some - some[0])
                score[first : first + 64] += np.bincount(owner, log_probs(flat, cut, counted), len(some) - 1)
            none = lambda n, kind: pa.nulls(n, kind)
            n = len(texts)
            told = [key, doc_id, held_out, pa.array(sizes.astype(np.int64) + 1), pa.array(n_known), pa.array(base), pa.array(score / np.log(10))]
            yield pa.RecordBatch.from_arrays([*told, none(n, pa.string()), none(n, pa.int64())], names=names)
            rest = np.flatnonzero(~known[code])
            if len(rest):
                pairs, times = np.unique(text[rest] * len(known) + code[rest], return_counts=True)
                n = len(pairs)
                told = [key.take(pa.array(pairs // len(known))), none(n, pa.int64()), none(n, pa.bool_()), none(n, pa.int64()), none(n, pa.int64())]
                told += [none(n, pa.float64()), none(n, pa.float64()), coded.dictionary.take(pa.array(pairs % len(known))).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*told, pa.array(times, pa.int64())], names=names)

    return run


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    Tokens are the words, A-Z lower-cased, and one end. ``base_score`` adds up ``log10((c + 0.1) / (N + 0.1 (V + 1)))``:
    ``c`` counts the token, ``N`` all, ``V`` the different ones, in all documents that are not held out. ``score`` is
    the log10-probability of the text, its end included, by the attention model. ``n_known`` counts tokens met there.

    Null texts are empty: one end. Rows that are repeated are documents of their own; a null id is neither held out nor
    learnt from. Without documents to learn from, ``N`` and ``V`` are 0. An empty table gives no rows; only the two
    columns named are read. Texts of any length are cut into windows, each id being scored once.

    The words that are sent to the tasks are a bounded number of short ones. All others, which are not frequent, are
    joined by word with their counts, so no count is left out.
    """
    path = tokenizer or tokenizer_path()
    spark = df.sparkSession
    rows = training(df, id_col, text_col)
    learn = rows.filter("learn")
    counts = materialise(word_counts(learn), "words")
    n_docs = learn.count()
    told = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    train_tokens, different = told[0] + n_docs, told[1] + (1 if n_docs else 0)
    below = train_tokens + SMOOTHING * (different + 1)
    ids = Ids.of(np.append(id_counts(counts, path), n_docs))
    flat = train(rows, ids, path)
    words, top_counts = _top_words(counts)
    end_log = float(np.log10((n_docs + SMOOTHING) / below))
    sent = spark.sparkContext.broadcast((words, np.log10((top_counts + SMOOTHING) / below), end_log, int(n_docs > 0), ids, flat))
    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, unit string, times long"
    keyed = rows.select(F.struct(F.monotonically_increasing_id().alias("key"), "doc_id", "held_out").alias("row"), "text")
    found = materialise(keyed.mapInArrow(_scored(sent, path), schema), "scored")
    rest = found.filter("unit IS NOT NULL").select(F.col("key").alias("_key"), "unit", "times").join(counts, "unit", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + F.lit(SMOOTHING)) / F.lit(below))
    rest = rest.groupBy("_key").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * log).alias("_base")
    )
    out = found.filter("unit IS NULL").join(rest, F.col("key") == F.col("_key"), "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op12_lm_scores(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))
