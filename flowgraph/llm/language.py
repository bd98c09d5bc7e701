"""Language ID by unigram models over a fixed piece vocabulary, summed over all segmentations of a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, texts
from .pieces import MARK, model_path
from .tokens import MEMORY_UNITS, steps

#: The labelled sample: so many documents of each language, chosen by hash, and so many different words of each.
TRAIN_DOCS, TRAIN_WORDS = 200, 10_000
#: Languages at most; more labels than this are an error, as the sample is brought to the driver.
MAX_LANGUAGES = 200
ROUNDS, SMOOTHING, UNKNOWN = 4, 0.1, 1e-7
#: A longer run of letters is scored in parts.
WORD_CHARS = 32
NONE = "und"

#: Letters alone: no digits, fractions, circled or Roman numerals.
_LETTERS = regex.compile(r"\p{L}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODDS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SLOTS = 20


class Pieces:
    """The vocabulary's pieces of lower-case letters, found in many words at once by rolling hashes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.names = sorted(x for x in names if (w := x.removeprefix(MARK)) == w.lower() and (not w or _LETTERS.fullmatch(w)) and len(x) <= WORD_CHARS)
        self.longest = max(map(len, self.names))
        self.hashes = np.zeros(len(self.names), np.uint64)
        for size in range(1, self.longest + 1):
            at = [i for i, x in enumerate(self.names) if len(x) == size]
            if at:
                self.hashes[at] = self._prefixes(self._codes([self.names[i] for i in at], size))[:, -1]
        # Two tables of places; what meets another in the first goes to the second, what does so there is searched for.
        self.tables = [np.full(1 << _SLOTS, -1, np.int32) for _ in _ODDS]
        left = np.arange(len(self.names))
        for places, odd in zip(self.tables, _ODDS, strict=True):
            slot = self._slot(self.hashes[left], odd)
            _, first = np.unique(slot, return_index=True)
            places[slot[first]] = left[first]
            left = np.delete(left, first)
        self.rest = {int(self.hashes[i]): int(i) for i in left}
        self.powers = [np.uint64(pow(int(_BASE), i, 2**64)) for i in range(WORD_CHARS + 2)]

    @staticmethod
    def _slot(hashes: np.ndarray, odd: np.uint64) -> np.ndarray:
        return ((hashes * odd) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    @staticmethod
    def _codes(words: list[str], size: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size).astype(np.uint64)

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + (codes[:, j] + np.uint64(1))
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        found = self.tables[0][self._slot(hashes, _ODDS[0])]
        found = np.where(self.hashes[found] == hashes, found, -1)
        miss = np.flatnonzero(found < 0)
        again = self.tables[1][self._slot(hashes[miss], _ODDS[1])]
        found[miss] = np.where(self.hashes[again] == hashes[miss], again, -1)
        for h, i in self.rest.items():
            found[hashes == np.uint64(h)] = i
        return found

    def arcs(self, words: list[str], size: int):
        """For words of one length: (start, end, rows, piece) of all pieces in them. A character that is no piece is
        the piece past the last."""
        prefix = self._prefixes(self._codes(words, size))
        for end in range(1, size + 1):
            for start in range(max(0, end - self.longest), end):
                piece = self.find(prefix[:, end] - prefix[:, start] * self.powers[end - start])
                if end - start == 1:
                    piece = np.where(piece < 0, len(self.names), piece)
                    yield start, end, slice(None), piece
                elif len(rows := np.flatnonzero(piece >= 0)):
                    yield start, end, rows, piece[rows]


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _by_size(words: list[str], most: int = 20_000):
    """Places of words of one length, some at a time."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for i in range(0, len(at), most):
            yield int(size), at[i : i + most]


def word_scores(words: list[str], probs: np.ndarray, path: str) -> np.ndarray:
    """Log-probability of each (marked) word for each language: the forward algorithm over all segmentations."""
    out = np.zeros((len(words), probs.shape[1]))
    for size, at in _by_size(words):
        ahead = np.zeros((size + 1, len(at), probs.shape[1]))
        ahead[0] = 1
        for start, end, rows, piece in pieces(path).arcs([words[i] for i in at], size):
            ahead[end, rows] += ahead[start, rows] * probs[piece]
        out[at] = np.log(ahead[size])
    return out


def fit(counts: list[dict[str, int]], path: str) -> np.ndarray:
    """Piece probabilities (pieces and "unknown", by language) that expectation maximisation gives for the word counts
    of each language; smoothing leaves no piece at zero."""
    known = pieces(path)
    words = sorted(set().union(*counts)) if counts else []
    times = np.array([[c.get(w, 0) for c in counts] for w in words], float).reshape(len(words), len(counts))
    probs = np.full((len(known.names) + 1, len(counts)), 1 / len(known.names))
    probs[-1] = UNKNOWN
    for _ in range(ROUNDS):
        expected = np.full(probs.shape, SMOOTHING)
        for size, at in _by_size(words):
            arcs = list(known.arcs([words[i] for i in at], size))
            ahead, behind = np.zeros((2, size + 1, len(at), len(counts)))
            ahead[0], behind[size] = 1, 1
            for start, end, rows, piece in arcs:
                ahead[end, rows] += ahead[start, rows] * probs[piece]
            for start, end, rows, piece in reversed(arcs):
                behind[start, rows] += behind[end, rows] * probs[piece]
            weight = times[at] / ahead[size]
            for start, end, rows, piece in arcs:
                np.add.at(expected, piece, ahead[start, rows] * probs[piece] * behind[end, rows] * weight[rows])
        probs = expected / expected[:-1].sum(axis=0)
        probs[-1] = UNKNOWN
    return probs


class Scorer:
    """What a worker remembers of the parts of texts between blanks: letters, and log-probability by language."""

    def __init__(self, probs: np.ndarray, path: str):
        self.probs, self.path = probs, path
        self.clear()

    def clear(self) -> None:
        self.places, self.rows = {"": 0}, np.zeros((1, 1 + self.probs.shape[1]))

    def _learn(self, parts: list[str]) -> None:
        words: dict[str, int] = {}
        owner, place = [], []
        letters = np.zeros(len(parts))
        for i, part in enumerate(parts):
            for run in _LETTERS.findall(part.lower()):
                letters[i] += len(run)
                for at in range(0, len(run), WORD_CHARS - 1):
                    owner.append(i)
                    place.append(words.setdefault((MARK if not at else "") + run[at : at + WORD_CHARS - 1], len(words)))
        new = np.zeros((len(parts), self.rows.shape[1]))
        new[:, 0] = letters
        if words:
            scores = word_scores(list(words), self.probs, self.path)
            np.add.at(new[:, 1:], owner, scores[place])
        self.rows = np.concatenate([self.rows, new])

    def score(self, batch: pa.Array) -> np.ndarray:
        """Letters, and log-probability by language, of each text."""
        if not len(batch):
            return np.zeros((0, self.rows.shape[1]))
        if len(self.places) > MEMORY_UNITS // 2:
            self.clear()
        cut = pc.split_pattern(pc.replace_substring(batch, "\n", " "), " ")
        sizes = pc.list_value_length(cut).to_numpy()
        coded = cut.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.array([-1 if p is None else p for p in map(self.places.get, names)], np.int64)
        if len(unknown := np.flatnonzero(at < 0)):
            new, first = [names[i] for i in unknown.tolist()], len(self.places)
            self.places.update(zip(new, range(first, first + len(new)), strict=True))
            at[unknown] = np.arange(first, first + len(new))
            self._learn(new)
        at = at[coded.indices.to_numpy()]
        ends = np.cumsum(sizes)  # never empty: a text has a part at least
        out = np.zeros((len(batch), self.rows.shape[1]))
        for column in range(out.shape[1]):
            out[:, column] = np.add.reduceat(self.rows[at, column], ends - sizes)
        return out


_SCORERS: dict[str, Scorer] = {}


def _parts(run: Column) -> Column:
    """A run of letters as ``Scorer`` takes it: in parts of ``WORD_CHARS - 1``, the first one marked."""
    cut = lambda at: F.concat(F.when(at == 0, MARK).otherwise(""), run.substr(at + 1, F.lit(WORD_CHARS - 1)))
    return F.transform(F.sequence(F.lit(0), F.length(run) - 1, F.lit(WORD_CHARS - 1)), cut)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: str | None = None):
    """Languages (sorted) and piece probabilities, learnt from documents with a language and an id whose crc32, as
    text, leaves a remainder by 5. At most ``TRAIN_DOCS`` documents and ``TRAIN_WORDS`` words of each language, so what
    the driver gets has a bound. Long runs of letters are learnt in parts, all of them. An empty sample gives no language;
    more than ``MAX_LANGUAGES`` are an error."""
    rows = df.select(
        df[id_col].cast("long").alias("doc_id"), df[lang_col].alias("lang"), F.coalesce(df[text_col], F.lit("")).alias("text")
    ).filter("lang IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 <> 0")
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError("too many languages")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.select("doc_id", "lang", rank.alias("rank")).filter(F.col("rank") <= TRAIN_DOCS).select("doc_id").distinct()
    words = (
        rows.join(F.broadcast(chosen), "doc_id", "left_semi")  # ids of TRAIN_DOCS documents of MAX_LANGUAGES languages at most
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        .select("lang", F.explode(_parts(F.col("word"))).alias("word"))
        .groupBy("lang", "word")
        .count()
    )
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    counts: list[dict[str, int]] = [{} for _ in langs]
    for r in words.withColumn("rank", top).filter(F.col("rank") <= TRAIN_WORDS).collect():
        counts[langs.index(r["lang"])][r["word"]] = r["count"]
    return langs, fit(counts, model or model_path())


def predict(df: DataFrame, langs: list[str], probs: np.ndarray, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text: the language most probable, all being as likely beforehand,
    and its probability.

    A text that is null or has no letters, or any text if no language was learnt, gets ``und`` and 0. Letters are
    those of any script, in lower case; ties go to the first language by name. Rows that are repeated are judged each;
    an empty table gives none; only the two columns named are read.
    """
    from uuid import uuid4

    path, key = model or model_path(), uuid4().hex
    sent = df.sparkSession.sparkContext.broadcast((langs, probs))  # pieces times languages, however large the input

    def run(batches):
        names, table_ = sent.value
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(table_, path) if names else None
        for doc_ids, rows in steps(batches):
            n = len(rows)
            best, score = np.full(n, NONE, object), np.zeros(n)
            if names:
                found = _SCORERS[key].score(rows)
                logs = found[:, 1:]
                first = logs.argmax(axis=1)
                some = found[:, 0] > 0
                best[some] = np.array(names, object)[first[some]]
                chance = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                score[some] = chance[some]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, *train(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
