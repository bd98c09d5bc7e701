"""Repeated passages: each byte covered by a string of ``length`` bytes that also starts earlier goes.

A repeat is found by expanding intervals of a Burrows-Wheeler transform up to ``length`` characters. One transform
of a corpus is one machine's work, so the strings of ``length`` bytes are dealt out first: each is sent where its
least ``SEED``-byte part (by hash) sends it, together with its neighbours of the same part. Equal strings meet, no
string is in two places, and only parts that occur again are sent at all. Each place has a transform of its own.

1. Documents are dealt to units of some megabytes, once; the three steps below read that one exchange.
2. Units tell their parts' hashes and counts; those that occur again are told back as bits.
3. Units send the stretches around such parts to their places, equal stretches of a unit once. Parts that are very
   frequent are told apart by a longer stretch around them, so that no place gets all of a common line.
4. A place unites equal stretches, expands intervals over the different ones, and tells units which strings are later
   ones. Units cover their bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, table, texts

LENGTH, SEED = 100, 32
#: Bytes of a unit, on average, and of a stretch of text whose parts are found at a time.
UNIT_BYTES, CHUNK = 2 << 20, 1 << 17
#: Bytes of the input for each place, and for each task of an exchange, at most on average.
PLACE_BYTES, TASK_BYTES = 8 << 20, 32 << 20
#: A part is frequent from so many occurrences on; its strings are then dealt by parts that so many starts share.
FREQUENT, NARROW = 1_000, 10
#: Text that one transform holds, if the strings of one part do not need more.
TRANSFORM_BYTES = 256 << 10
#: Intervals are expanded from the strings of so many characters on, which are told apart directly.
GRAM = 8
_PLACE_BITS = np.uint64(18)  # of a place in a chunk
_SEPARATOR = 0xFF  # no byte of UTF-8

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def part_hashes(data: np.ndarray, size: int = SEED) -> np.ndarray:
    """A hash of the ``size`` bytes (a multiple of 8) from each place on: words of 8 bytes, stirred and then added with
    weights of their own."""
    word = data.astype(np.uint64)
    for shift in (1, 2, 4):
        word = word[:-shift] | word[shift:] << np.uint64(8 * shift)
    word *= _K[0]
    word ^= word >> np.uint64(32)
    n = len(data) - size + 1
    out = word[:n] * _K[1]
    for i in range(1, size // 8):
        out += word[8 * i : 8 * i + n] * _K[1 + i % 4]
    out ^= out >> np.uint64(29)
    out *= _K[2]
    out ^= out >> np.uint64(32)
    return out


def stretches(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """``(first, count, at, part)`` of the stretches of documents side by side in ``data``, which start at ``starts``
    (with the end): runs of ``count`` neighbouring strings whose least part is that at ``at`` with hash ``part``.

    A long text is taken in chunks; a stretch that a chunk's end cuts is two.
    """
    window = length - seed + 1
    rest = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(data))  # bytes to the document's end
    out = []
    for begin in range(0, max(0, len(data) - length + 1), CHUNK):
        text = data[begin : begin + CHUNK + length - 1]
        hashes = part_hashes(text, seed)
        n = len(text) - length + 1
        keyed = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.full(-(-len(keyed) // window) * window, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(keyed)] = keyed
        blocks = padded.reshape(-1, window)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])
        at = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        ok = np.flatnonzero(rest[begin : begin + n] >= length)
        if not len(ok):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(ok) != 1) | (at[ok[1:]] != at[ok[:-1]])]))
        first = ok[new]
        count = np.diff(np.append(new, len(ok)))
        out.append((first + begin, count, at[first] + begin, hashes[at[first]]))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))
    first, count, at, part = (np.concatenate(x) for x in zip(*out, strict=True))
    # The least hashes are all small: stirred again, they deal evenly.
    part = (part ^ (part >> np.uint64(31))) * _K[4]
    return first, count, at, part ^ (part >> np.uint64(32))


def narrowed(data, first, count, at, length: int = LENGTH, seed: int = SEED):
    """Stretches of frequent parts, cut so that at most ``NARROW`` neighbouring strings are in one: by where the part
    lies in the string. Their key is a hash of the ``length - NARROW + 1`` bytes that all strings at such a place share,
    a part of the text that depends on the string alone."""
    firsts, counts, keys = [], [], []
    for step in range(-(-(length - seed + 1) // NARROW)):
        low, high = step * NARROW, step * NARROW + NARROW - 1  # the part's place in the string
        begin, end = np.maximum(first, at - high), np.minimum(first + count - 1, at - low)
        some = np.flatnonzero(begin <= end)
        if not len(some):
            continue
        firsts.append(begin[some])
        counts.append((end - begin + 1)[some])
        shared = at[some] - low
        size = length - NARROW + 1
        keys.append(_window_hashes(data, shared, size, step))
    return tuple(map(np.concatenate, (firsts, counts, keys))) if firsts else (first[:0], count[:0], np.zeros(0, np.uint64))


def _window_hashes(data: np.ndarray, at: np.ndarray, size: int, salt: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    raw = data.tobytes()
    return np.array([xxh3_64_intdigest(raw[a : a + size], salt + 1) for a in at.tolist()], np.uint64)


# --- The transform ---------------------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int = 128) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes (a power of two times 8)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    _, rank = np.unique(key, return_inverse=True)
    size = 8
    while size < depth:
        after = np.zeros(n, np.int64)
        after[: max(0, n - size)] = rank[size:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (n + 2) + after, return_inverse=True)
        size *= 2
    return np.argsort(rank, kind="stable")


def repeated_intervals(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each whether it has ``length`` characters in common with the one before.

    The common prefix of neighbours is found by increasing value. Where strings of ``GRAM`` characters end in the
    order is read off the text. Then, for one character more at a time, the intervals are extended backwards on the
    Burrows-Wheeler transform: a border inside the interval of a string gives one inside that of the string with a
    character in front. What has no border when ``length`` is reached has that much in common; larger values are
    never derived.
    """
    n = len(text)
    order = suffix_order(text, 8 * 2 ** max(0, math.ceil(math.log2(length / 8))))
    before = text[order - 1]  # the transform; the first suffix is preceded by the last byte, a separator
    step = np.argsort(before, kind="stable")  # where the suffix without its first character stands
    padded = np.concatenate([text, np.zeros(GRAM, np.uint8)])
    border = np.zeros(n, np.int32)
    border[0] = 1
    gram = min(GRAM, length)
    for i in range(gram):
        letter = padded[order + i]
        border[1:] |= letter[1:] != letter[:-1]
    open_ = np.flatnonzero(border == 0)
    low, high = step[open_ - 1], step[open_]
    for _ in range(gram, length):
        if not len(open_):
            break
        borders = np.cumsum(border, dtype=np.int32)
        new = borders[high] > borders[low]
        if not new.any():
            break  # no border is left that could give another
        border[open_[new]] = 1
        left = ~new
        open_, low, high = open_[left], low[left], high[left]
    return order, border == 0


def later_strings(content: list[bytes], order_of: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, offset) of all strings of ``length`` bytes in ``content`` that are not the first of their kind;
    ``order_of`` gives the order of the stretches, and within one the offset does."""
    joined = np.frombuffer(b"".join(x for c in content for x in (c, b"\xff")), np.uint8)
    sizes = np.array([len(c) + 1 for c in content])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(content)), sizes)
    order, same = repeated_intervals(joined, length)
    offset = order - starts[owner[order]]
    fits = offset + length <= sizes[owner[order]] - 1
    run = np.cumsum(~same)
    inside = np.flatnonzero(fits & (same | np.append(same[1:], False)))
    run, who, off = run[inside], owner[order[inside]], offset[inside]
    by = np.lexsort((off, order_of[who], run))
    run, who, off = run[by], who[by], off[by]
    later = np.concatenate([[False], run[1:] == run[:-1]]) if len(run) else np.zeros(0, bool)
    return who[later], off[later]


# --- Steps on Spark --------------------------------------------------------------------------------------------------


def _unit_texts(found: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A unit's documents by id (null first) and text: their ids, their bytes side by side, and where each starts (and
    the end)."""
    if not found.num_rows:
        return pa.array([], pa.int64()), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ids, text = (found.column(n).combine_chunks() for n in ("doc_id", "text"))
    text = text.cast(pa.large_string())
    order = pc.sort_indices(pa.table({"n": pc.is_valid(ids), "i": ids, "t": text}), [("n", "ascending"), ("i", "ascending"), ("t", "ascending")])
    ids, text = ids.take(order), text.take(order)
    starts = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return ids, data, starts - starts[0]


def _parted(keys: np.ndarray, n: int) -> np.ndarray:
    """The place, of ``n``, that a hash is sent to."""
    return ((keys >> np.uint64(33)).astype(np.int64) * n) >> 31


_SENT = (
    "place int, unit long, keys binary, digests binary, ids binary, ordinals binary, firsts binary, counts binary, text binary,"
    " copy_ordinals binary, copy_firsts binary, copy_counts binary"
)
_LATER = "unit long, ordinals binary, firsts binary, counts binary"


def _column(found: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in found.column(name).to_pylist()]


def judge_place(found: pa.Table, length: int, transform_bytes: int) -> pa.Table:
    """Later strings among the stretches that were sent to one place, by unit."""
    units_of = np.array(found.column("unit").to_pylist())
    columns = {n: _column(found, n, k) for n, k in (("keys", np.uint64), ("ids", np.int64), ("ordinals", np.uint32), ("firsts", np.int64), ("counts", np.uint16))}
    unit = np.repeat(units_of, [len(x) for x in columns["keys"]])
    keys, ids, ordinals, firsts, counts = (np.concatenate(columns[n]) for n in ("keys", "ids", "ordinals", "firsts", "counts"))
    raw = b"".join(found.column("text").to_pylist())
    ends = np.cumsum(counts.astype(np.int64) + length - 1)
    begins = ends - counts - (length - 1)
    # The order of documents is that of ids, then of units and of places in the unit.
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((firsts, ordinals, unit, ids))] = np.arange(len(keys))
    # Equal stretches: the first stays, the others are later ones as a whole.
    low, high = np.frombuffer(b"".join(found.column("digests").to_pylist()), np.uint64).reshape(-1, 2).T
    by = np.lexsort((rank, high, low, keys))
    alike = np.ones(max(0, len(by) - 1), bool)
    for x in (keys, low, high):
        alike &= x[by][1:] == x[by][:-1]
    again = np.concatenate([[False], alike])[: len(by)]
    copies, leads = by[again], by[~again]
    out = [(unit[copies], ordinals[copies], firsts[copies], counts[copies])]
    # Parts with different stretches: some of their strings may still be equal.
    groups = np.split(leads, np.flatnonzero(keys[leads][1:] != keys[leads][:-1]) + 1) if len(leads) else []
    batch: list[np.ndarray] = []
    held = 0

    def expand():
        at = np.concatenate(batch)
        content = [raw[a:b] for a, b in zip(begins[at].tolist(), ends[at].tolist(), strict=True)]
        who, off = later_strings(content, rank[at], length)
        out.append((unit[at[who]], ordinals[at[who]], firsts[at[who]] + off, np.ones(len(who), np.uint16)))

    for group in groups:
        if len(group) > 1:
            batch.append(group)
            held += int((ends[group] - begins[group] + 1).sum())
            if held >= transform_bytes:
                expand()
                batch, held = [], 0
    if batch:
        expand()
    for i, u in enumerate(units_of.tolist()):
        own = [np.frombuffer(found.column(n)[i].as_py(), k) for n, k in (("copy_ordinals", np.uint32), ("copy_firsts", np.int64), ("copy_counts", np.uint16))]
        out.append((np.full(len(own[0]), u), *own))
    unit, ordinals, firsts, counts = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.argsort(unit, kind="stable")
    names, begin = np.unique(unit[by], return_index=True)
    cut = lambda x, kind: pa.array([y.astype(kind).tobytes() for y in np.split(x[by], begin[1:])] if len(names) else [], pa.binary())
    return pa.table(
        {"unit": pa.array(names, pa.int64()), "ordinals": cut(ordinals, np.uint32), "firsts": cut(firsts, np.int64), "counts": cut(counts, np.uint16)}
    )


def repeated_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    unit_bytes: int = UNIT_BYTES, frequent: int = FREQUENT, transform_bytes: int = TRANSFORM_BYTES,
) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of each row of ``df``: the maximal runs of bytes (start, end) of its UTF-8 text
    that go, and the bytes that are left, put together.

    A byte goes if a string of ``length`` bytes around it also starts earlier: in a document of a smaller ``doc_id``
    (null is the smallest; equal ids by a hash of the text, then by text), or in the same one. Strings are judged on the input, matches may overlap
    and never cross documents. Null counts as empty; an empty text has no spans; of rows that are repeated the first is
    the earlier. An empty table gives no rows; only the two columns named are read. Whole stretches of text are told
    equal by 128 bits of hash; strings inside different ones by their bytes.
    """
    if length < SEED + NARROW:
        raise ValueError("strings must be longer than the parts that they are dealt by")
    spark = df.sparkSession
    docs = texts(df, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = max(1, -(-total // unit_bytes))
    places = max(partitions(spark), -(-total // PLACE_BYTES))
    # Dealt by id and text, so that rows of one id, or without any, are no hot group; tasks by bytes of the input.
    tasks = max(partitions(spark), -(-total // TASK_BYTES))
    dealt = docs.withColumn("unit", F.pmod(F.xxhash64("doc_id", "text"), F.lit(units))).repartition(tasks, "unit")

    def tell(key, found):
        _, data, starts = _unit_texts(found)
        part = stretches(data, starts, length)[3]
        part, count = np.unique(part, return_counts=True)
        cuts = np.searchsorted(_parted(part, places), np.arange(places + 1))
        some = np.flatnonzero(np.diff(cuts))
        return pa.table(
            {
                "place": pa.array(some, pa.int32()),
                "unit": pa.array([key[0].as_py()] * len(some), pa.int64()),
                "parts": pa.array([part[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()),
                "counts": pa.array([np.minimum(count[cuts[i] : cuts[i + 1]], 65535).astype(np.uint16).tobytes() for i in some], pa.binary()),
            }
        )

    def tell_back(key, found):
        """0: once in all; 1: again; 2: frequent."""
        parts, counts = _column(found, "parts", np.uint64), _column(found, "counts", np.uint16)
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        times = np.bincount(at, np.concatenate(counts))
        said = ((times > 1).astype(np.uint8) + (times >= frequent))[at]
        back = np.split(said, np.cumsum([len(p) for p in parts])[:-1])
        return pa.table({"unit": found.column("unit"), "place": found.column("place"), "said": pa.array([x.tobytes() for x in back], pa.binary())})

    def send(key, found, said):
        from xxhash import xxh3_128_digest

        doc_ids, data, starts = _unit_texts(found)
        first, count, at, part = stretches(data, starts, length)
        names = np.unique(part)
        told = np.concatenate([np.frombuffer(x, np.uint8) for x in said.sort_by("place").column("said").to_pylist()] or [np.zeros(0, np.uint8)])
        mine = told[np.searchsorted(names, part)] if len(names) else told
        often = mine == 2
        first2, count2, key2 = narrowed(data, first[often], count[often], at[often], length)
        some = mine == 1
        first, count, keys = (np.concatenate(x) for x in ((first[some], first2), (count[some], count2), (part[some], key2)))
        by = np.argsort(first, kind="stable")
        first, count, keys = first[by], count[by], keys[by]
        raw = data.tobytes()
        digests = [xxh3_128_digest(raw[a : a + c + length - 1]) for a, c in zip(first.tolist(), count.tolist(), strict=True)]
        # Equal stretches of the unit: only the first is sent, the others are later ones as a whole.
        fresh = np.zeros(len(first), bool)
        fresh[list({d: i for i, d in reversed(list(enumerate(digests)))}.values())] = True
        owner = np.searchsorted(starts, first, "right") - 1
        ids = np.array([np.iinfo(np.int64).min if x is None else x for x in doc_ids.to_pylist()], np.int64)
        where = _parted(keys, places)
        rows = {n: [] for n in ("place", "unit", "keys", "digests", "ids", "ordinals", "firsts", "counts", "text", "copy_ordinals", "copy_firsts", "copy_counts")}
        by = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[by], np.arange(places + 1))
        local = first - starts[owner] if len(first) else first
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            mine = by[cuts[i] : cuts[i + 1]]
            a, c = mine[fresh[mine]], mine[~fresh[mine]]
            rows["place"].append(i)
            rows["unit"].append(key[0].as_py())
            rows["keys"].append(keys[a].tobytes())
            rows["digests"].append(b"".join([digests[j] for j in a.tolist()]))
            rows["ids"].append(ids[owner[a]].tobytes())
            rows["ordinals"].append(owner[a].astype(np.uint32).tobytes())
            rows["firsts"].append(local[a].tobytes())
            rows["counts"].append(count[a].astype(np.uint16).tobytes())
            rows["text"].append(b"".join([raw[s : s + n + length - 1] for s, n in zip(first[a].tolist(), count[a].tolist(), strict=True)]))
            rows["copy_ordinals"].append(owner[c].astype(np.uint32).tobytes())
            rows["copy_firsts"].append(local[c].tobytes())
            rows["copy_counts"].append(count[c].astype(np.uint16).tobytes())
        kinds = {"place": pa.int32(), "unit": pa.int64()}
        return pa.table({n: pa.array(x, kinds.get(n, pa.binary())) for n, x in rows.items()})

    def judge(key, found):
        return judge_place(found, length, transform_bytes)

    def cover(key, found, later):
        doc_ids, data, starts = _unit_texts(found)
        ordinals = np.concatenate([np.zeros(0, np.uint32), *_column(later, "ordinals", np.uint32)]).astype(np.int64)
        firsts = np.concatenate([np.zeros(0, np.int64), *_column(later, "firsts", np.int64)])
        counts = np.concatenate([np.zeros(0, np.uint16), *_column(later, "counts", np.uint16)]).astype(np.int64)
        begin = starts[ordinals] + firsts
        change = np.bincount(begin, minlength=len(data) + 1) - np.bincount(begin + counts + length - 1, minlength=len(data) + 1)
        gone = np.cumsum(change)[: len(data)] > 0
        # Edges of runs; a run never goes on into the next document.
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        heads = starts[:-1][np.diff(starts) > 0]
        opens[heads] = gone[heads]
        begins = np.flatnonzero(opens)
        ends = np.flatnonzero(np.append(opens[1:] | ~gone[1:], True) & gone) + 1 if len(gone) else begins
        owner = np.searchsorted(starts, begins, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(begins - starts[owner]), pa.array(ends - starts[owner])], ["start", "end"])
        bounds = np.searchsorted(begins, starts)
        left = np.concatenate([[0], np.cumsum(~gone)])[starts]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc_ids), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[~gone])])
        return pa.table(
            {
                "doc_id": doc_ids,
                "n_bytes": pa.array(np.diff(starts), pa.int64()),
                "spans": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans),
                "kept": kept.cast(pa.binary()),
            }
        )

    by_unit = dealt.groupBy("unit")
    told = by_unit.applyInArrow(tell, "place int, unit long, parts binary, counts binary")
    said = told.repartition(tasks, "place").groupBy("place").applyInArrow(tell_back, "unit long, place int, said binary")
    sent = by_unit.cogroup(said.groupBy("unit")).applyInArrow(send, _SENT)
    later = sent.repartition(tasks, "place").groupBy("place").applyInArrow(judge, _LATER)
    return by_unit.cogroup(later.groupBy("unit")).applyInArrow(
        cover, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


def op5_suffix_dedup(spark, sf_dir):
    found = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
