"""Encoding and decoding with a byte-pair vocabulary of the sentencepiece kind.

Merging pairs by score gives every text, and so every prefix of a text, one encoding.  The prefix of
length e ends in the one piece t that is compatible with the last piece of the prefix before t: the
two, put together, merge to themselves, which a replay of their merges side by side decides.  So the encoder keeps one table, the length of the last piece
of every prefix.  The pieces that end at e come from an automaton over the vocabulary, the pair test
is remembered, and the ids are read off the table from its end.  Time is linear in the text whatever
it holds, also for a text without any space.

Two facts about the vocabulary, worked out from its pieces, cut texts where no merge can cross: a
space mark never follows another character inside a piece, and a character in no longer piece stands
alone.  The stretches between such places are encoded once and remembered (``MEMORY`` of them).

The vocabulary travels with the tasks (some hundred kB); its path is a parameter of ``load``.

Cases: null and empty texts have no ids and decode to the empty text; a space mark in the text itself
decodes as a space, as in the library; characters without a piece become their bytes (or the unknown
id, without byte pieces); other columns stay.  Decoding takes any ids: control ids give nothing, bytes
that form no character give the replacement character, each; an id outside the vocabulary is an error.
Vocabularies that rewrite texts first or hold unused pieces are refused; pieces of the user-defined
kind are merged like any other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlens.llm.common import add_columns

SPACE = "▁"
#: Stretches and pairs of pieces that a worker remembers: of stretches two generations, the elder dropped when the
#: younger is full.
MEMORY = 250_000
#: Longer stretches are encoded each time.
LONG = 64
NEVER = float("-inf")
UNKNOWN_TEXT = " ⁇ "
LOST = "�".encode()


@dataclass
class Vocabulary:
    """Pieces with scores, the ids of bytes, and what does not print."""

    pieces: dict[str, int]
    scores: dict[str, float]
    bytes_ids: list[int]
    unknown: int
    control: frozenset[int]
    size: int
    stable: list[str] = field(default_factory=list)

    @cached_property
    def digest(self) -> str:
        return hashlib.sha256(repr((self.scores, self.bytes_ids, self.unknown, sorted(self.control))).encode()).hexdigest()

    def merge(self, text: str) -> list[str]:
        """Best pair first, leftmost among equals: the definition of the encoding."""
        parts = list(text)
        while len(parts) > 1:
            at = self.best(parts)[1]
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def best(self, parts: list[str]) -> tuple[float, int]:
        """Score and place of the next merge."""
        best, at = NEVER, -1
        for i in range(len(parts) - 1):
            score = self.scores.get(parts[i] + parts[i + 1])
            if score is not None and score > best:
                best, at = score, i
        return best, at

    def merges(self, text: str) -> list[tuple[float, str, str]]:
        """Before every merge, and at the end: score of the merge, first and last part."""
        parts, steps = list(text), []
        while True:
            score, at = self.best(parts)
            steps.append((score, parts[0], parts[-1]))
            if at < 0:
                return steps
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    odd = "A  ﬁ  Ｂ"
    made = "".join(model.encode(odd, out_type=str))
    if not made.startswith(SPACE) or (made != SPACE + odd.replace(" ", SPACE) and model.decode(model.encode(odd)) != odd):
        raise ValueError("the vocabulary rewrites texts before it encodes them")
    if any(model.is_unused(i) for i in range(size)):
        raise ValueError("unused pieces are not supported")
    control = frozenset(i for i in range(size) if model.is_control(i))
    raw = {i for i in range(size) if model.is_byte(i)}
    pieces = {
        model.id_to_piece(i): i for i in range(size) if i not in control and i not in raw and not model.is_unknown(i)
    }
    scores = {p: model.get_score(i) for p, i in pieces.items()}
    bytes_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if raw else []
    words = Vocabulary(pieces, scores, bytes_ids, model.unk_id(), control, size)
    words.stable = [p for p in pieces if words.merge(p) == [p]]
    assert words.digest  # worked out once, here; it travels with the vocabulary
    return words


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.ending = ahocorasick.Automaton()
        self.longer = [p for p in words.stable if len(p) > 1]
        for piece in self.longer:
            self.ending.add_word(piece, len(piece))
        if self.longer:
            self.ending.make_automaton()
        joined = sorted({c for p in words.pieces if len(p) > 1 for c in p})
        inner = "".join(re.escape(c) for c in joined if c != SPACE)
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in words.pieces)
        if crossing:
            self.cut = re.compile(f"[{inner}{SPACE}]+|.", re.S)
        elif inner:
            self.cut = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|.", re.S)
        else:
            self.cut = re.compile(f"{SPACE}+|.", re.S)
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.old: dict[str, tuple[tuple[int, ...], str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.histories: dict[str, list[tuple[float, str, str]]] = {}
        self.prints = [b""] * words.size
        for piece, i in words.pieces.items():
            self.prints[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(words.bytes_ids):
            self.prints[i] = bytes([b])
        self.prints[words.unknown] = UNKNOWN_TEXT.encode()
        self.raw = frozenset(words.bytes_ids)
        self.leading = frozenset(i for p, i in words.pieces.items() if p.startswith(SPACE))

    def history(self, piece: str) -> list[tuple[float, str, str]]:
        """The merges that make a piece: score of the next merge, first and last part before it."""
        known = self.histories.get(piece)
        if known is None:
            known = self.histories[piece] = self.words.merges(piece) if piece in self.words.pieces else [(NEVER, piece, piece)]
        return known

    def compatible(self, left: str, right: str) -> bool:
        """Replays the merges of both pieces side by side; the pair fails if a merge across them comes first."""
        a, b, scores = self.history(left), self.history(right), self.words.scores
        i = j = 0
        while True:
            x, y = a[i][0], b[j][0]
            across = scores.get(a[i][2] + b[j][1])
            if across is not None and across > x and across >= y:
                return False
            if x >= y:
                if x == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def fits(self, left: str, right: str) -> bool:
        """Two pieces that, put together, stay these two pieces."""
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            known = self.pairs[pair] = self.compatible(left, right)
        return known

    def last_pieces(self, text: str) -> list[int]:
        """The length of the last piece of every prefix, by its end; 0 stands for one character."""
        last = [0] * (len(text) + 1)
        known = self.pairs.get
        for end, size in self.ending.iter(text) if self.longer else ():
            end += 1
            if not last[end]:
                start = end - size
                if start:
                    left, right = text[start - (last[start] or 1) : start], text[start:end]
                    fits = known((left, right))
                    if not (self.fits(left, right) if fits is None else fits):
                        continue
                last[end] = size
        return last

    def stretch(self, text: str) -> tuple[int, ...]:
        last = self.last_pieces(text)
        found: list[int] = []
        end = len(text)
        while end:
            size = last[end] or 1
            piece = text[end - size : end]
            number = self.words.pieces.get(piece)
            if number is not None:
                found.append(number)
            elif self.words.bytes_ids:
                found.extend(self.words.bytes_ids[b] for b in reversed(piece.encode("utf-8", "replace")))
            elif not found or found[-1] != self.words.unknown:
                found.append(self.words.unknown)
            end -= size
        return tuple(reversed(found))

    def stretches(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """Ids of the stretches of a text, each with its listing."""
        if not text:
            return []
        made = []
        for part in self.cut.findall(SPACE + text.replace(" ", SPACE)):
            one = self.known.get(part)
            if one is None:
                one = self.old.get(part)
                if one is None:
                    ids = self.stretch(part)
                    one = ids, ",".join(map(str, ids))
                if len(part) <= LONG:
                    if len(self.known) >= MEMORY:
                        self.known, self.old = {}, self.known
                    self.known[part] = one
            made.append(one)
        return made

    def encode(self, text: str) -> list[int]:
        ids = list(chain.from_iterable(one[0] for one in self.stretches(text)))
        if not self.words.bytes_ids:  # characters without a piece that stand side by side are one unknown
            unknown = self.words.unknown
            ids = [i for at, i in enumerate(ids) if i != unknown or not at or ids[at - 1] != unknown]
        return ids

    def decode(self, ids: Sequence[int]) -> bytes:
        """The text of the ids, as UTF-8."""
        first = next((at for at, i in enumerate(ids) if i not in self.words.control), None)
        if first is None:
            return b""
        data = b"".join(map(self.prints.__getitem__, ids))
        try:
            data.decode("utf-8")
            whole = self.words.control.isdisjoint(ids)
        except UnicodeDecodeError:
            whole = False
        if not whole:
            data = self.decode_runs(ids)
        return data[1:] if ids[first] in self.leading else data

    def decode_runs(self, ids: Sequence[int]) -> bytes:
        """Byte pieces judged run by run; a byte that starts no character is lost alone."""
        done: list[bytes] = []
        run = bytearray()
        for i in [*ids, None]:
            if i is not None and i in self.raw:
                run += self.prints[i]
                continue
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        bytes(run[at : at + size]).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    done.append(bytes(run[at : at + size]))
                    at += size
                    break
                else:
                    done.append(LOST)
                    at += 1
            run.clear()
            if i is not None:
                done.append(self.prints[i])
        return b"".join(done)


_CODECS: dict[str, Codec] = {}


def codec_of(words: Vocabulary) -> Codec:
    """The codec of a vocabulary, built once per Python worker and kept for its next tasks."""
    if words.digest not in _CODECS:
        _CODECS.clear()
        _CODECS[words.digest] = Codec(words)
    return _CODECS[words.digest]


def clear(text: bytes | None) -> str:
    return text.decode("utf-8", "replace") if text else ""


def encode(
    docs: DataFrame, words: Vocabulary, *, text_col: str = "text", to: str = "ids", keep: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` with ``to``, the ids of ``text_col``; a column of that name is replaced."""

    def start():
        codec = codec_of(words)
        return lambda texts: [[codec.encode(clear(t)) for t in texts]]

    return add_columns(docs, [text_col], [T.StructField(to, T.ArrayType(T.IntegerType()))], start, keep)


def decode(
    df: DataFrame, words: Vocabulary, *, ids_col: str = "ids", to: str = "decoded", keep: Sequence[str] | None = None
) -> DataFrame:
    """``df`` with ``to``, the text of ``ids_col`` (null: empty); a column of that name is replaced."""

    def start():
        codec = codec_of(words)
        return lambda ids: [[codec.decode(i or ()).decode("utf-8") for i in ids]]

    return add_columns(df, [ids_col], [T.StructField(to, T.StringType())], start, keep)


def round_trip(
    docs: DataFrame, words: Vocabulary, *, text_col: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` with ``n_tokens`` and the digests of the ids (decimal, comma-joined) and of the decoded text.

    Encodes and decodes in one stage, so that ids, several for each word, never leave the task.
    """

    def start():
        codec = codec_of(words)

        def work(texts):
            counts, ids_hash, text_hash = [], [], []
            for text in texts:
                value = clear(text)
                if words.bytes_ids:
                    made = codec.stretches(value)
                    ids, listing = list(chain.from_iterable(one[0] for one in made)), ",".join([one[1] for one in made])
                else:
                    ids = codec.encode(value)
                    listing = ",".join(map(str, ids))
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(listing.encode()).hexdigest())
                text_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return [counts, ids_hash, text_hash]

        return work

    fields = [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    return add_columns(docs, [text_col], fields, start, keep)


def token_totals(docs: DataFrame, words: Vocabulary, by: Sequence[str], *, text_col: str = "text") -> DataFrame:
    """Rows and tokens per group, for budgets in tokens; groups are combined before the shuffle."""
    counted = round_trip(docs, words, text_col=text_col, keep=list(by))
    return counted.groupBy(*by).agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))
