"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field learns from a small table of lines labelled by hand (``pii_lines``), with many numbers that are no personal
data. It adds what the patterns can't tell: numbers that only the word before them makes a phone's or a card's.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, texts
from .pii_lines import LINES
from .tokens import steps

KINDS = ("email", "ip", "card", "phone")
#: One in so many lines of the labelled table is held out.
HELD_OUT = 4
ROUNDS, RATE, DECAY = 300, 0.1, 1e-3
#: Words before a run of numbers that tell what it is: of a phone, of a card, of mail, or of a number of another kind.
CUES = (
    "tel phone telephone telefon telefonnummer rufnummer fon fax mobile mob mobil handy cell hotline whatsapp call text dial ring contact"
    " unter tél téléphone appelez le portable teléfono llame al móvil at is",
    "card credit visa mastercard amex kreditkarte carte tarjeta with",
    "mail e-mail email to write send",
    "order invoice no nr ticket case version release chapter page isbn issn part model serial seriennummer tracking parcel room raum"
    " rechnung bestellung number account konto iban item article product sku batch id ref reference code código pedido commande facture"
    " line lot form row seat key size zip plz postcode katalog of from on and about between",
)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_BLANK = "\t\n\x0b\x0c\r "


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the fixed patterns, in order. Each scan is linear in the text.

    A local part is read backwards from its at sign, and an address starts where its digits do: both give the
    leftmost match of the pattern without trying every place of a long word.
    """
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- Word shapes -----------------------------------------------------------------------------------------------------

_MARKED = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_EDGE = "\"'<>[]{}.,;:!?"
_BOUNDS = (0, 1, 3, 6, 7, 9, 13, 19)  # digits of a word, by class
_MARKS = 11
#: Behind a word's own features: the cue before its chain, that and the class of its digits, and digits of the whole chain.
_CUED = 1 + len(_BOUNDS) + 1 + _MARKS
_FEATURES = _CUED + (len(CUES) + 1) * (len(_BOUNDS) + 2) + len(_BOUNDS) + 1
_CUE_OF = {w: i for i, words in enumerate(CUES) for w in words.split()}


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words with a digit or an at sign, on one line: start and end of each word.

    The field's other words are never personal data (a constraint of the model), so chains do not depend on
    each other and decoding them alone gives the best path of the whole text.
    """
    out: list[list[tuple[int, int]]] = []
    last = -1
    for m in _MARKED.finditer(text):
        start = m.start()
        while start > max(last, 0) and text[start - 1] not in _BLANK:
            start -= 1
        between = text[last:start] if last >= 0 else "\n"
        if last >= 0 and "\n" not in between and not between.strip(_BLANK):
            out[-1].append((start, m.end()))
        else:
            out.append([(start, m.end())])
        last = m.end()
    return out


def shape(word: str) -> tuple[int, ...]:
    """Indices of the word's features."""
    core = word.strip(_EDGE)
    digits = "".join(_DIGITS.findall(core))
    n = len(digits)
    dotted = core.count(".") == 3 and core.replace(".", "").isascii() and core.replace(".", "").isdigit() and ".." not in core
    name, _, host = core.partition("@")
    marks = (
        "@" in core,
        bool(name) and "." in host.strip("."),
        any(c.isalpha() for c in core),
        core.startswith("+"),
        "(" in core and ")" in core,
        "-" in core,
        dotted,
        dotted and _octets(core),
        14 <= n <= 19 and luhn(digits),
        any(c not in _LOCAL and c not in "()@" for c in core),
        n == len(core),
    )
    size = sum(n > b for b in _BOUNDS)
    return (0, 1 + size, *(2 + len(_BOUNDS) + i for i, m in enumerate(marks) if m))


def chain_shapes(text: str, chain: list[tuple[int, int]]) -> list[tuple[int, ...]]:
    """Features of the words of a chain: their own, and what the word before the chain and the whole chain tell."""
    start = chain[0][0]
    line = text[max(0, start - 40) : start].rpartition("\n")[2].split()
    cue = _CUE_OF.get(line[-1].strip(_EDGE + "()").lower(), len(CUES)) if line else len(CUES)
    digits = sum(n > b for n in [len(_DIGITS.findall(text[chain[0][0] : chain[-1][1]]))] for b in _BOUNDS)
    out = []
    for a, b in chain:
        own = shape(text[a:b])
        wide = _CUED + cue * (len(_BOUNDS) + 2)
        out.append((*own, wide, wide + 1 + digits, _CUED + (len(CUES) + 1) * (len(_BOUNDS) + 2) + digits))
    return out


class Field:
    """Linear-chain conditional random field; label 0 is "none", then the kinds. Chains begin and end beside a 0."""

    def __init__(self):
        self.weights = np.zeros((_FEATURES, 1 + len(KINDS)))
        self.moves = np.zeros((1 + len(KINDS),) * 2)

    def _pad(self, shapes: list[list[tuple[int, ...]]]):
        longest = max(map(len, shapes))
        x = np.zeros((len(shapes), longest, _FEATURES))
        for i, chain in enumerate(shapes):
            for t, features in enumerate(chain):
                x[i, t, list(features)] = 1
        return x, np.array([len(c) for c in shapes])

    def fit(self, shapes: list[list[tuple[int, ...]]], labels: list[list[int]]) -> Field:
        """Gradient ascent (Adam) on the likelihood; the same input gives the same weights. Chains are short."""
        if not shapes:
            return self
        x, sizes = self._pad(shapes)
        n, longest, _ = x.shape
        k = self.moves.shape[0]
        there = np.arange(longest) < sizes[:, None]
        gold = np.zeros((n, longest), int)
        for i, row in enumerate(labels):
            gold[i, : len(row)] = row
        want_w = np.einsum("ntf,ntk->fk", x, np.eye(k)[gold] * there[..., None])
        want_m = np.zeros((k, k))
        edge = np.concatenate([np.zeros((n, 1), int), gold * there, np.zeros((n, 1), int)], axis=1)
        for t in range(longest + 1):
            np.add.at(want_m, (edge[sizes >= t, t], edge[sizes >= t, t + 1]), 1)
        theta = [self.weights, self.moves]
        first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
        for step in range(1, ROUNDS + 1):
            e = x @ self.weights
            ahead = np.zeros((n, longest, k))
            behind = np.zeros((n, longest, k))
            ahead[:, 0] = self.moves[0] + e[:, 0]
            for t in range(1, longest):
                ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + self.moves, axis=1) + e[:, t]
            for t in range(longest - 1, -1, -1):
                last = (sizes - 1 == t)[:, None]
                onward = 0 if t == longest - 1 else np.logaddexp.reduce(self.moves + (e[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
                behind[:, t] = np.where(last, self.moves[:, 0], onward)
            whole = np.logaddexp.reduce(ahead[np.arange(n), sizes - 1] + self.moves[:, 0], axis=1)
            marginal = np.exp(ahead + behind - whole[:, None, None]) * there[..., None]
            got_w = np.einsum("ntf,ntk->fk", x, marginal)
            got_m = np.zeros((k, k))
            got_m[0] += marginal[:, 0].sum(axis=0)
            got_m[:, 0] += marginal[np.arange(n), sizes - 1].sum(axis=0)
            for t in range(1, longest):
                on = sizes > t
                pair = ahead[on, t - 1, :, None] + self.moves + (e[on, t] + behind[on, t])[:, None, :] - whole[on, None, None]
                got_m += np.exp(pair).sum(axis=0)
            for p, want, got, m, v in zip(theta, (want_w, want_m), (got_w, got_m), first, second, strict=True):
                slope = (want - got) / n - DECAY * p
                m += 0.1 * (slope - m)
                v += 0.001 * (slope**2 - v)
                p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def decode(self, shapes: list[list[tuple[int, ...]]]) -> list[list[int]]:
        """Viterbi, for all chains of one length at a time."""
        out: list[list[int]] = [[]] * len(shapes)
        sizes = np.array([len(c) for c in shapes])
        cache: dict[tuple[int, ...], np.ndarray] = {}
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            e = np.empty((len(at), size, self.moves.shape[0]))
            for r, i in enumerate(at):
                for t, features in enumerate(shapes[i]):
                    if (row := cache.get(features)) is None:
                        row = cache[features] = self.weights[list(features)].sum(axis=0)
                    e[r, t] = row
            best, back = self.moves[0] + e[:, 0], []
            for t in range(1, size):
                paths = best[:, :, None] + self.moves
                back.append(paths.argmax(axis=1))
                best = paths.max(axis=1) + e[:, t]
            path = [(best + self.moves[:, 0]).argmax(axis=1)]
            for step in reversed(back):
                path.append(step[np.arange(len(at)), path[-1]])
            for i, row in zip(at, np.stack(path[::-1], axis=1).tolist(), strict=True):
                out[i] = row
        return out


_MARKED_SPAN = re.compile(r"\{(\w+)\|([^}]*)\}")


def labelled(line: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text of a line of the labelled table, and its spans (start, kind, end)."""
    text, spans, at = "", [], 0
    for m in _MARKED_SPAN.finditer(line):
        text += line[at : m.start()]
        spans.append((len(text), KINDS.index(m[1]), len(text) + len(m[2])))
        text, at = text + m[2], m.end()
    return text + line[at:], spans


def table_parts() -> tuple[list[str], list[str]]:
    """Lines of the labelled table to learn from, and those held out."""
    return [x for i, x in enumerate(LINES) if i % HELD_OUT], LINES[::HELD_OUT]


def train(lines: list[str] | None = None) -> Field:
    """The field, from lines of the labelled table (those not held out). It is small and part of the package, so the
    model is the same for every input; no line gives a field that adds nothing."""
    shapes, labels = [], []
    for line in table_parts()[0] if lines is None else lines:
        text, spans = labelled(line)
        for chain in chains(text):
            shapes.append(chain_shapes(text, chain))
            labels.append([next((1 + kind for start, kind, end in spans if start < b and a < end), 0) for a, b in chain])
    return Field().fit(shapes, labels)


def added_spans(batch: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans of the field that touch no base span: neighbouring words of one label, without marks at the edges."""
    where = [(i, chain) for i, text in enumerate(batch) for chain in chains(text)]
    paths = field.decode([chain_shapes(batch[i], chain) for i, chain in where])
    out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    for (i, chain), path in zip(where, paths, strict=True):
        t = 0
        while t < len(path):
            end = t + 1
            while end < len(path) and path[end] == path[t]:
                end += 1
            if path[t]:
                a, b = chain[t][0], chain[end - 1][1]
                found = batch[i][a:b]
                a, b = a + len(found) - len(found.lstrip(_EDGE)), b - len(found) + len(found.rstrip(_EDGE))
                if a < b and not any(start < b and a < stop for start, _, stop in base[i]):
                    out[i].append((a, path[t] - 1, b))
            t = end
    return out


SPANS = "doc_id long, base array<struct<kind:int,start:int,end:int>>, added array<struct<kind:int,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _both(batch: list[str], field: Field):
    base = [base_spans(t) for t in batch]
    return base, added_spans(batch, base, field)


def find_pii(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``added`` spans (kind as a place in ``KINDS``; code points, end exclusive) of every
    whole text, by start and then kind.

    Null and empty texts have none; rows that are repeated have the same; an empty table gives no rows; only the two
    columns named are read. Time is linear in the text, however long a word is.
    """

    def run(batches):
        for ids, rows in steps(batches):
            found = [
                pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in sorted(spans)] for spans in some], _SPAN)
                for some in _both(rows.to_pylist(), field)
            ]
            yield pa.RecordBatch.from_arrays([ids, *found], names=["doc_id", "base", "added"])

    return texts(df, id_col, text_col).mapInArrow(run, SPANS)


def redact(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``df`` with each span of its texts replaced by its kind in brackets; spans that overlap become one, under the
    first one's kind. Other columns, null texts and texts without a span are left alone."""
    at = df.columns.index(text_col)

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for a, kind, b in spans:
            if a >= done:
                out += [text[done:a], f"[{KINDS[kind].upper()}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches):
        for batch in batches:
            done = 0
            pairs = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
            for _, rows in steps(iter([pairs])):
                found = rows.to_pylist()
                base, added = _both([t or "" for t in found], field)
                new = [t if t is None else clean(t, sorted(b + a)) for t, b, a in zip(found, base, added, strict=True)]
                part = batch.slice(done, len(found))
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
                done += len(found)

    return df.mapInArrow(run, df.schema)


def _listed(spans):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def op7_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, train())
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))
