"""Token ids of whole texts, their files with Elias-Fano boundaries, and packing by powers of two."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .common import table, texts

#: Ids that end a document, in the files and in the packed sequences.
FILE_END_ID, PACK_END_ID = 2, 0
MAX_LENGTH = 1024
#: A file of ids is closed at the first document end past this many ids.
FILE_IDS = 4 << 20
#: Writing tasks whose files' offsets are added up together.
BLOCK_PARTS = 1024
#: Units whose ids a worker remembers; then it starts anew. Bytes of text that are taken at a time.
MEMORY_UNITS, STEP_BYTES = 600_000, 4 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Units:
    """What a worker remembers of units, the parts of texts that recur: a run of numbers for each."""

    def __init__(self, kind: type = np.uint16):
        self.places: dict[str, int] = {"": 0}
        self.flat = np.empty(0, kind)
        self.starts, self.lengths, self.uses = (np.zeros(1, np.int64) for _ in range(3))

    def learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of new units in one array, and where those of each unit start and how many they are."""
        raise NotImplementedError

    def forget(self) -> None:
        """Keep only units that were met again since they were learnt or last kept."""
        kept = [(u, p) for u, p in self.places.items() if not u or self.uses[p] > 1]
        at = np.array([p for _, p in kept])
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - lengths), lengths)]
        self.starts, self.lengths = ends - lengths, lengths
        self.places = {u: i for i, (u, _) in enumerate(kept)}
        self.uses = np.zeros(len(kept), np.int64)

    def rows(self, cut: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all units of lists of units, in one array, and the end of each list in it."""
        if len(self.places) > MEMORY_UNITS:
            self.forget()
        sizes = pc.list_value_length(cut).to_numpy()
        coded = cut.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        units = np.array([-1 if p is None else p for p in map(self.places.get, names)], np.int64)
        if len(at := np.flatnonzero(units < 0)):
            new = [names[i] for i in at.tolist()]
            first = len(self.places)
            self.places.update(zip(new, range(first, first + len(new)), strict=True))
            units[at] = np.arange(first, first + len(new))
            flat, starts, lengths = self.learn(new)
            self.starts = np.concatenate([self.starts, starts + len(self.flat)])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses[units] += 1
        units = units[coded.indices.to_numpy()]
        lengths = self.lengths[units]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat((self.starts[units] - ends[:-1]).astype(np.int32), lengths)
        at += np.arange(ends[-1], dtype=np.int32)
        return self.flat[at], ends[np.cumsum(sizes)]


def side_by_side(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays as one, and where each starts and how long it is."""
    lengths = np.array([len(x) for x in found])
    return np.concatenate(found), np.cumsum(lengths) - lengths, lengths


class Encoder(Units):
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library.

    Merges never cross the places where the vocabulary's pattern cuts a text, and it always cuts before a single
    blank and around a single line end. So texts are split there, and the library encodes each different unit once,
    many in a call. Texts with other white space, or with two of them together, go to the library whole.
    """

    #: White space besides single blanks and line ends.
    OTHER = "[ \\n]{2}|[\\x00\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids are held in 16 bits")
        # The same merges over texts already cut and mapped to the vocabulary's characters, one for each byte.
        self.merges = Tokenizer.from_file(path)
        self.merges.encode_special_tokens = True
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.char_of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.marks = {c: self.tokenizer.token_to_id(c) for c in ".,;:?!)"}
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i)) for i in range(size)], dtype=np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new units. Words, and words with one mark behind, are cut here; the library cuts all others.

        A mark behind a word that is known already needs no call: the pattern parts them.
        """
        words, cut, known, other = [], [], [], []
        for i, u in enumerate(units):
            word = u[1:] if u[0] == " " else u
            if word.isalpha():
                words.append(i)
                cut.append(u)
            elif word[-1:] in self.marks and word[:-1].isalpha():
                if (place := self.places.get(u[:-1], len(self.starts))) < len(self.starts):
                    known.append((i, place, self.marks[u[-1]]))
                else:
                    words.append(i)
                    cut.append(f"{u[:-1]}\n{u[-1]}")
            else:
                other.append(i)
        starts, lengths = np.zeros((2, len(units)), np.int64)
        runs, done = [], 0
        if known:  # the word's own ids, and the mark's
            at, places, marks = np.array(known).T
            lengths[at] = self.lengths[places] + 1
            ends = np.cumsum(lengths[at])
            starts[at] = ends - lengths[at]
            run = np.empty(ends[-1], np.uint16)
            run[ends - 1] = marks
            inner = np.ones(ends[-1], bool)
            inner[ends - 1] = False
            own = self.lengths[places]
            run[inner] = self.flat[np.arange(own.sum()) + np.repeat(self.starts[places] - (np.cumsum(own) - own), own)]
            runs, done = [run], len(run)
        if other:
            run, first, lengths[other] = side_by_side(self._whole([units[i] for i in other]))
            starts[other] = done + first
            runs.append(run)
            done += len(run)
        for at in range(0, len(words), 2000):
            some = cut[at : at + 2000]
            sizes = np.cumsum([len(u.encode()) - u.count("\n") for u in some])
            mapped = "\n".join(some).encode().decode("latin-1").translate({**self.char_of, 10: "\n"})
            run = np.array(self.merges.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, np.uint16)
            bounds = np.concatenate([[0], np.searchsorted(np.cumsum(self.bytes_of[run]), sizes) + 1])
            starts[words[at : at + 2000]] = done + bounds[:-1]
            lengths[words[at : at + 2000]] = np.diff(bounds)
            runs.append(run)
            done += len(run)
        return np.concatenate(runs), starts, lengths

    def encode(self, batch: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text; the caller bounds the batch (see ``steps``)."""
        batch = batch if isinstance(batch, pa.Array) else pa.array(batch, pa.large_string())
        if not len(batch):
            return []
        whole = pc.match_substring_regex(batch, self.OTHER)
        out: list[np.ndarray] = [None] * len(batch)
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        for i, ids in zip(at, self._whole(batch.take(pa.array(at)).to_pylist()), strict=True):
            out[i] = ids
        rows = np.flatnonzero(~whole.to_numpy(zero_copy_only=False))
        if not len(rows):
            return out
        plain = pc.replace_substring(batch.take(pa.array(rows)), " ", "\x00 ")
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", "\x00\n\x00"), "\x00")
        flat, ends = self.rows(cut)
        for i, ids in zip(rows, np.split(flat, ends[:-1]), strict=True):
            out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def steps(batches: Iterator[pa.RecordBatch], size: int = STEP_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of ``doc_id, text`` batches, about ``size`` bytes at a time."""
    for batch in batches:
        bounds = batch.column(1).cast(pa.large_string())
        ends = np.frombuffer(bounds.buffers()[1], np.int64)[bounds.offset : bounds.offset + len(bounds) + 1] if len(bounds) else np.zeros(1, np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
            yield batch.column(0).slice(at, end - at), bounds.slice(at, end - at)
            at = end


# --- Elias-Fano ------------------------------------------------------------------------------------------------------


class EliasFano:
    """A rising sequence of ``n`` numbers up to ``top`` in ``2 + log2(top / n)`` bits each.

    The lower bits of a number stand in a packed array; the upper ones as gaps of ones in a bit vector, with the place
    of each ``STRIDE``-th one for selection.
    """

    STRIDE = 256

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        upper = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(int(upper[-1]) + n if n else 0, np.uint8)
        ones = upper + np.arange(n)
        bits[ones] = 1
        lower = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, low_bits, np.packbits(lower.ravel()), np.packbits(bits), ones[:: cls.STRIDE].astype(np.uint32 if len(bits) < 2**32 else np.uint64))

    def _lower(self, first: int, last: int) -> np.ndarray:
        """Lower bits of the numbers from ``first`` to before ``last``."""
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        begin, end = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[begin // 8 : (end + 7) // 8])[begin % 8 :][: end - begin]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (bits.reshape(-1, self.low_bits) * weights).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The ``i``-th number, from the nearest sampled one on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = self._place(i)
        return ((place - i) << self.low_bits) | int(self._lower(i, i + 1)[0])

    def _place(self, i: int) -> int:
        """The place of the ``i``-th one among the upper bits, from the nearest sampled one on."""
        at, left = int(self.samples[i // self.STRIDE]), i % self.STRIDE
        byte = at // 8
        left += int(np.unpackbits(self.high[byte : byte + 1])[: at % 8].sum())
        while left >= (ones := int(self.high[byte]).bit_count()):
            left -= ones
            byte += 1
        return byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1]))[left])

    def some(self, first: int, last: int) -> np.ndarray:
        """The numbers from the ``first``-th to before the ``last``-th; only their bits are unpacked."""
        if last <= first:
            return np.zeros(0, np.uint64)
        begin, end = self._place(first), self._place(last - 1)
        byte = begin // 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte : end // 8 + 1])) + 8 * byte
        ones = ones[(ones >= begin) & (ones <= end)]
        return ((ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)) | self._lower(first, last)

    def up_to(self, most: int) -> int:
        """How many numbers are ``most`` at most, by bisection over ``select``."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self.select(middle) <= most:
                low = middle + 1
            else:
                high = middle
        return low

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBBQQQ", self.n, self.low_bits, self.samples.itemsize, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, width, low, high, samples = struct.unpack_from("<QBBQQQ", data, at)
        at += struct.calcsize("<QBBQQQ")
        parts = []
        for count, kind in ((low, np.uint8), (high, np.uint8), (samples, np.uint32 if width == 4 else np.uint64)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += count * np.dtype(kind).itemsize
        return cls(n, low_bits, *parts), at


MAGIC = b"EFTOKEN1"


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file format: magic, counts, Elias-Fano of the document ends, Elias-Fano of the (sorted) document ids over
    the first, then all ids as little-endian unsigned 16-bit integers. Null document ids come first; they are counted.
    """
    real = [d for d in doc_ids if d is not None]
    base = real[0] if real else 0
    names = EliasFano.of(np.array([d - base for d in real], np.uint64))
    ends = EliasFano.of(np.cumsum(lengths, dtype=np.uint64))
    head = struct.pack("<8sQQq", MAGIC, len(doc_ids) - len(real), len(ids), base)
    return head + ends.to_bytes() + names.to_bytes() + ids.astype("<u2").tobytes()


class TokenFile:
    """A file of token ids as it is: names and ends of its documents stay in their Elias-Fano form, and offsets are
    selected from it."""

    def __init__(self, data: bytes):
        magic, self.nulls, self.n_ids, self.base = struct.unpack_from("<8sQQq", data)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.ends, at = EliasFano.read(data, struct.calcsize("<8sQQq"))
        self.names, at = EliasFano.read(data, at)
        self.ids = np.frombuffer(data, "<u2", self.n_ids, at)
        self.n_docs = self.ends.n

    def start(self, i: int) -> int:
        """Where the ``i``-th document starts; that of the one past the last is the file's length."""
        return self.ends.select(i - 1) if i else 0

    def document(self, i: int) -> np.ndarray:
        """The ids of the ``i``-th document."""
        return self.ids[self.start(i) : self.start(i + 1)]

    def batches(self, size: int) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about ``size`` ids, one document at least."""
        at = 0
        while at < self.n_docs:
            end = max(at + 1, self.ends.up_to(self.start(at) + size))
            yield at, end
            at = end

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        nulls = max(0, min(last, self.nulls) - first)
        return [None] * nulls + [self.base + int(x) for x in self.names.some(max(first - self.nulls, 0), max(last - self.nulls, 0))]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


MANIFEST = "part long, seq long, path string, n_docs long, n_ids long"


def write_token_files(
    df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end_id: int = FILE_END_ID, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode every whole text, end it with ``end_id`` and write the ids to files under ``folder``, a shared folder,
    in ascending order of ``doc_id`` (nulls first; equal ids by text). Returns the manifest, one row per file in the
    order ``part, seq``; it is written by Spark, so it only lists files of tasks that ended well.

    Null and empty texts are documents of the end id alone; an empty table gives no file. A document is never split,
    however long. Other columns are not read. ``tokenizer`` is a path that every executor can read.
    """
    path = tokenizer or tokenizer_path()

    def write(batches):
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        arrays: list[np.ndarray] = []
        held = 0

        def close():
            nonlocal docs, arrays, held, seq
            filesystem, base = _filesystem(folder)
            filesystem.create_dir(base, recursive=True)
            name = f"ids-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.bin"
            with filesystem.open_output_stream(f"{base}/{name}") as out:
                out.write(file_bytes(docs, [len(a) for a in arrays], np.concatenate(arrays)))
            row = pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "path": [f"{folder}/{name}"], "n_docs": [len(docs)], "n_ids": [held]}
            )
            docs, arrays, held, seq = [], [], 0, seq + 1
            return row

        end = np.array([end_id], np.uint16)
        for ids, rows in steps(batches):
            for doc_id, found in zip(ids.to_pylist(), encoder(path).encode(rows), strict=True):
                docs.append(doc_id)
                arrays.append(np.concatenate([found, end]))
                held += len(found) + 1
                if held >= file_ids:
                    yield close()
        if docs:
            yield close()

    ordered = texts(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files; ``start`` counts the ids of all documents
    before it, and ``ids`` are little-endian unsigned 32-bit integers. Offsets come from the files' own structures by
    selection, for some documents at a time."""
    # A running sum over files without one task or the driver seeing them all: within a writing task, within blocks of
    # these tasks, and over the blocks.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids")).withColumn("block", F.expr(f"part div {BLOCK_PARTS}"))
    before = lambda n, by: F.sum(n).over(by) - F.col(n)
    blocks = parts.groupBy("block").agg(F.sum("part_ids").alias("block_ids"))
    blocks = blocks.select("block", before("block_ids", Window.orderBy("block")).alias("block_start"))
    parts = parts.withColumn("part_start", before("part_ids", Window.partitionBy("block").orderBy("part"))).join(blocks, "block")
    own = manifest.withColumn("own_start", before("n_ids", Window.partitionBy("part").orderBy("seq")))
    files = own.join(parts, "part").select("path", F.expr("block_start + part_start + own_start").alias("start"))

    def read(batches):
        for batch in batches:
            for path, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                filesystem, name = _filesystem(path)
                with filesystem.open_input_stream(name) as f:
                    found = TokenFile(f.read())
                for at, end in found.batches(1 << 20):
                    begin = found.start(at)
                    ends = found.ends.some(at, end).astype(np.int64) - begin
                    data = found.ids[begin : begin + int(ends[-1])].astype("<u4").tobytes()
                    starts = np.concatenate([[0], ends[:-1]])
                    bounds = (4 * np.append(starts, ends[-1])).astype(np.int64)
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - at, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.doc_ids(at, end), pa.int64()), pa.array(starts + begin + first), pa.array(ends - starts), ids.cast(pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    n = max(1, files.count())
    return files.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op6_token_files(spark, sf_dir):
    manifest = write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "token-ids"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# --- Packing ---------------------------------------------------------------------------------------------------------


def pieces_of(lengths: np.ndarray, most: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For documents of ``lengths`` ids: the document and the length of each piece, in order. Lengths are ``most`` as
    often as it goes, then the powers of two that make up the rest, the largest first."""
    lengths = np.asarray(lengths, np.int64)
    full, rest = lengths // most, lengths % most
    docs, order, sizes = [np.repeat(np.arange(len(lengths)), full)], [np.zeros(int(full.sum()), np.int64)], [np.full(int(full.sum()), most)]
    for k, bit in enumerate(1 << np.arange(most.bit_length() - 2, -1, -1), 1):
        has = np.flatnonzero(rest & bit)
        docs.append(has)
        order.append(np.full(len(has), k))
        sizes.append(np.full(len(has), bit))
    docs, order, sizes = map(np.concatenate, (docs, order, sizes))
    by = np.lexsort((order, docs))
    return docs[by], sizes[by]


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end_id: int = PACK_END_ID, most: int = MAX_LENGTH,
) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: every document's ids and ``end_id``, cut into
    pieces whose lengths are powers of two up to ``most`` (itself one). A piece is a sequence of its own, so no
    sequence crosses documents and none is padded; sequences of equal length form a bucket, and a bucket's sequence ids
    are neighbours. No exchange is needed: a sequence id is the bucket, the task and a running number.

    Null and empty texts are documents of the end id alone; an empty table gives no piece; rows that are repeated are
    packed each. Other columns are not read. ``ids`` are little-endian unsigned 32-bit integers.
    """
    if most & (most - 1):
        raise ValueError("the longest piece must be a power of two")
    path = tokenizer or tokenizer_path()

    def cut(batches):
        end = np.array([end_id], np.uint16)
        for doc_ids, rows in steps(batches):
            found = encoder(path).encode(rows)
            lengths = np.array([len(x) + 1 for x in found], np.int64)
            flat = np.concatenate([y for x in found for y in (x, end)])
            docs, sizes = pieces_of(lengths, most)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            first = np.concatenate([[0], np.cumsum(lengths)])[docs]
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.take(pa.array(docs)),
                    pa.array(bounds[:-1] - first),
                    pa.array(sizes),
                    pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(docs), [None, pa.py_buffer((4 * bounds).astype(np.int64)), pa.py_buffer(flat.astype("<u4"))]
                    ).cast(pa.binary()),
                    pa.array(lengths[docs]),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    cuts = texts(df, id_col, text_col).mapInArrow(cut, PIECES)
    bucket = F.lit(most.bit_length() - 1) - F.round(F.log2("length")).cast("long")  # the longest first
    return cuts.select(
        "*",
        (F.shiftleft(bucket, 56) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def op8_packing(spark, sf_dir):
    return pack_digest(table(spark, sf_dir, "documents"))


def pack_digest(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc32_of(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
