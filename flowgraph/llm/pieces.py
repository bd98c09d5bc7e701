"""SentencePiece encoding and decoding: words in a trie, one forward pass over shared prefixes.

The vocabulary files at hand are of the BPE kind: a piece's score is its rank among merges, and the right path through
a word is the one that merging reaches, not the one with the largest sum. That path still has a Viterbi form. The
encoding of a prefix that ends at a piece's end is the encoding's own prefix, and a row of pieces is an encoding if and
only if each two neighbours are one by themselves. So the forward state of a prefix is its last piece: the only one
that agrees with the state where it starts. States depend on the prefix alone; words are sorted, which lays out their
trie, and walked depth first, so that a common prefix is scored once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, texts
from .tokens import Units, side_by_side, steps

MARK = "▁"
#: Pairs of pieces whose agreement a worker remembers.
MEMORY_PAIRS = 500_000
_PARTS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_UNEVEN = f"^ |  |\x00|{MARK}"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder(Units):
    """Piece ids of texts, as the library gives them for the same file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        super().__init__(np.int32)
        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.bytes_by_id = {i: bytes([b]) for b, i in self.byte_ids.items()}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.scores = {self.names[i]: model.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.tails = {x[i:] for x in self.ids for i in range(len(x))}
        if "\n" in self.ids or any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("texts can't be cut before marks and around line ends with this vocabulary")
        self.pairs: dict[tuple[str, str], bool] = {}

    def _merged(self, text: str) -> list[str]:
        """The pieces that merging reaches; for two pieces at most, so short."""
        parts = list(text)
        while True:
            scored = [(self.scores[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.scores]
            if not scored:
                return parts
            i = -max(scored)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _agree(self, left: str, right: str) -> bool:
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= MEMORY_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._merged(left + right) == ([left, right] if left else [right])
        return known

    def learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new words: forward states along the trie, depth first, and a walk back for each word."""
        ids, tails, longest, pairs, agree = self.ids, self.tails, self.longest, self.pairs, self._agree
        found: list[np.ndarray] = [None] * len(units)
        states = [""]  # states[j]: the last piece of the encoding of the current word's first j characters
        before = ""
        for at in sorted(range(len(units)), key=units.__getitem__):
            word = units[at]
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                state = word[end - 1]  # a character without a piece stands alone
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    piece = word[start:end]
                    if piece in ids:
                        left = states[start]
                        fits = pairs.get((left, piece))
                        if fits is None:
                            fits = agree(left, piece)
                        if fits:  # only one piece does
                            state = piece
                            break
                    elif piece not in tails:
                        break  # no piece ends like this
                states.append(state)
            before = word
            path, end = [], len(word)
            while end:
                piece = states[end]
                path.append(piece)
                end -= len(piece)
            row: list[int] = []
            for piece in reversed(path):
                if piece in ids:
                    row.append(ids[piece])
                else:
                    row += [self.byte_ids[b] for b in piece.encode()]
            found[at] = np.array(row, np.int32)
        return side_by_side(found)

    def encode(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the end of each text's; a text begins with a mark, as in the library."""
        if not len(batch):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        uneven = pc.match_substring_regex(batch, _UNEVEN).to_numpy(zero_copy_only=False) | (pc.binary_length(batch).to_numpy() == 0)
        even, odd = np.flatnonzero(~uneven), np.flatnonzero(uneven)
        plain = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("", batch.type), batch.take(pa.array(even)), pa.scalar(" ", batch.type)), " ", f"\x00{MARK}")
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", "\x00\n\x00"), "\x00")
        rest = [_PARTS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in batch.take(pa.array(odd)).to_pylist()]
        parts = pa.concat_arrays([cut, pa.array(rest, cut.type)])
        order = np.argsort(np.concatenate([even, odd]))
        return self.rows(parts.take(pa.array(order)))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces side by side, bytes put together, marks back to blanks, the first one dropped."""
        out, held = [], b""
        for i in ids.tolist():
            if (b := self.bytes_by_id.get(i)) is not None:
                held += b
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = b""
            out.append(self.names[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id, pieces`` (array of ids) of every whole text; null and empty texts have none.

    Rows that are repeated are encoded each; an empty table gives none; only the two columns named are read. ``model``
    is a path that every executor can read. There is no exchange: a task sorts the words of some megabytes of its texts
    at a time, so memory is bounded and a lost task is simply run again.
    """
    path = model or model_path()

    def run(batches):
        for doc_ids, rows in steps(batches):
            ids, ends = encoder(path).encode(rows)
            bounds = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(bounds, pa.array(ids))], names=["doc_id", "pieces"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, pieces array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", model: str | None = None) -> DataFrame:
    """``doc_id, text`` of every row of piece ids; null and empty rows give the empty text."""
    path = model or model_path()

    def run(batches):
        for batch in batches:
            step = 2_000
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                found = [encoder(path).decode(np.array(x or [], np.int64)) for x in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(pieces_col).alias("pieces")).mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id, pieces, decoded, same``: ids, the text decoded from them, and whether it is the text."""
    path = model or model_path()

    def run(batches):
        for doc_ids, rows in steps(batches):
            own = encoder(path)
            ids, ends = own.encode(rows)
            found = [own.decode(x) for x in np.split(ids, ends[:-1])] if len(rows) else []
            bounds = pa.array(np.concatenate([[0], ends]), pa.int32())
            decoded = pa.array(found, pa.large_string())
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.ListArray.from_arrays(bounds, pa.array(ids)), decoded.cast(pa.string()), pc.equal(decoded, rows)],
                names=["doc_id", "pieces", "decoded", "same"],
            )

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, pieces array<int>, decoded string, same boolean")


def op2_sentencepiece(spark, sf_dir):
    found = round_trip(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.crc32(F.concat_ws(",", F.col("pieces").cast("array<string>"))).alias("pieces_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("same").alias("round_trip"),
    )
