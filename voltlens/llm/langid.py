"""Language identification with a linear-chain conditional random field over words.

Every word of a text (a run of letters, lower-cased) gets a language by forward-backward over the
whole text, so code-switched passages are labelled word by word.  Emission features: affixes of one
to three letters, letter n-grams of one to three, membership of learned lexicons; transitions are
learned with them.  Training chains short runs of words of different languages, as code-switched
text does; labels are those of the documents the runs come from.

The model is fitted on a bounded sample (``DOCS_PER_LANG`` documents per language, chosen by hash;
``SEQUENCES`` chains of ``CHAIN`` words); it has ``BUCKETS`` hashed weights per language.  Prediction
covers whole texts in one narrow stage: emissions are computed for slices of words and remembered, and
the recursions run over groups of texts side by side; neither grows with the number of different words.

Cases: null, empty and letterless texts are ``und`` with score 0 and no words; without labelled
documents everything is ``und``; ties go to the first language by code point.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlens.llm.common import add_columns, plain_names

BUCKETS = 1 << 16
DOCS_PER_LANG = 300
SEQUENCES = 1600
CHAIN = 48
EPOCHS = 4
LEXICON_SHARE = 0.8
LEXICON_COUNT = 3
#: Words whose emissions a task remembers, computed for ``SLICE`` words at once.
CACHE_WORDS = 200_000
SLICE = 20_000
#: Words that the recursions hold at once, but for a longer text.
GROUP_WORDS = 200_000
#: Words of a text that the recursions take one after the other.
SEGMENT = 128
CHUNK_BYTES = 2 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: bytes | None) -> list[str]:
    """Lower-cased words, none if the text has no letter."""
    found = WORD.findall(text.decode("utf-8", "replace").lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def features(words: Sequence[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, end to end, each once per word, and their number per word (at least one).

    A word stands between two marks.  Its features are the grams of one to three letters inside it, the
    grams of two to four that begin or end with a mark, and the lexicon that holds it.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes)) - starts[word]
    size = sizes[word]
    parts, gram = [], np.zeros(len(codes), np.uint64)
    for n in (1, 2, 3, 4):
        gram = (gram[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(n)) * MIX
        gram ^= gram >> np.uint64(29)
        place, room = at[: len(gram)], size[: len(gram)]
        edge = (place == 0) | (place == room - n)
        inside = (place > 0) & (place + n < room)
        used = inside if n == 1 else edge & (place + n <= room) | inside if n < 4 else edge & (place + n <= room)
        used = np.flatnonzero(used)
        parts.append((word[used] << 16) | (gram[used] % np.uint64(BUCKETS)).astype(np.int64))
    listed = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if listed:
        numbers = np.array(listed, np.int64)
        parts.append((numbers[:, 0] << 16) | numbers[:, 1])
    found = np.unique(np.concatenate(parts))
    return found & (BUCKETS - 1), np.bincount(found >> 16, minlength=len(words))


@dataclass
class Field:
    """A fitted field: languages, hashed emission weights, transition scores, lexicon (language numbers)."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)

    def emissions(self, words: Sequence[str]) -> np.ndarray:
        """Scores of words per language, and the share of their features that training has seen."""
        flat, sizes = features(words, self.lexicon)
        wide = self.wide[flat]
        sums = np.add.reduceat(wide, np.cumsum(sizes) - sizes, axis=0)
        sums[:, :-1] /= np.sqrt(sizes)[:, None]
        sums[:, -1] /= sizes
        return sums

    @cached_property
    def wide(self) -> np.ndarray:
        return np.concatenate((self.weights, self.weights.any(axis=1)[:, None]), axis=1).astype(np.float32)

    def posteriors(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Word posteriors of texts laid end to end (``sizes`` words each, at least one).

        Texts are cut into segments of ``SEGMENT`` words, which run side by side.  A segment multiplies the message
        that enters it by one matrix; the matrices of a text, taken in turn, give the messages at all cuts.
        """
        local = np.exp(scores - scores.max(axis=1, keepdims=True))
        step = np.exp(self.moves).astype(local.dtype)
        parts = -(-sizes // SEGMENT)
        first = np.cumsum(parts) - parts
        text = np.repeat(np.arange(len(sizes)), parts)
        place = np.arange(len(text)) - first[text]
        lengths = np.minimum(SEGMENT, sizes[text] - place * SEGMENT)
        starts = (np.cumsum(sizes) - sizes)[text] + place * SEGMENT
        before, after = np.ones((2, len(text), local.shape[1]), local.dtype)
        if len(text) > len(sizes):
            maps = self.segment_maps(local, step, starts, lengths, place)
            for n in range(1, int(parts.max())):
                at = first[parts > n] + n
                before[at] = unit(np.einsum("sk,skj->sj", before[at - 1], maps[at - 1]))
            for n in range(int(parts.max()) - 1, 0, -1):
                at = first[parts > n] + n
                after[at - 1] = unit(np.einsum("skj,sj->sk", maps[at], after[at]))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, before, after = starts[order], lengths[order], before[order], after[order]
        opens = (place == 0)[order][:, None]
        alive = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right")
        ahead, last = np.empty_like(local), before
        for t, n in enumerate(alive):
            at = starts[:n] + t
            moved = last[:n] @ step
            ahead[at] = last = unit(local[at] * (np.where(opens[:n], 1, moved) if t == 0 else moved))
        result, back = np.empty_like(local), after[: alive[-1]]
        for t in range(len(alive) - 1, -1, -1):
            n, at = alive[t], starts[: alive[t]] + t
            if len(back) < n:
                back = np.concatenate((back, after[len(back) : n]))
            result[at] = unit(ahead[at] * back)
            back = unit((back * local[at]) @ step.T)
        return result

    @staticmethod
    def segment_maps(local, step, starts, lengths, place) -> np.ndarray:
        """For every segment the matrix from the message before it to the message at its end, up to a factor."""
        k = local.shape[1]
        order = np.argsort(-lengths, kind="stable")
        maps = np.where((place == 0)[order][:, None, None], np.eye(k, dtype=local.dtype), step) * local[starts[order]][:, None, :]
        for t in range(1, int(lengths[order[0]])):
            n = int(np.searchsorted(-lengths[order], -(t + 1), side="right"))
            now = (maps[:n] @ step) * local[starts[order[:n]] + t][:, None, :]
            maps[:n] = now / now.sum(axis=(1, 2), keepdims=True)
        out = np.empty_like(maps)
        out[order] = maps
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / rows.sum(axis=1, keepdims=True)


def fit(samples: Sequence[tuple[str, bytes]], seed: int = 5) -> Field | None:
    """Fit a field on ``(language, text)`` pairs by stochastic gradient ascent of the likelihood."""
    texts = [(lang, words_of(text)) for lang, text in samples]
    texts = [(lang, words) for lang, words in texts if words]
    langs = sorted({lang for lang, _ in texts})
    if not langs:
        return None
    counts: dict[str, Counter] = {lang: Counter() for lang in langs}
    for lang, words in texts:
        counts[lang].update(words)
    total = Counter()
    for c in counts.values():
        total.update(c)
    lexicon = {
        w: k for k, lang in enumerate(langs) for w, n in counts[lang].items()
        if n >= LEXICON_COUNT and n >= LEXICON_SHARE * total[w]
    }
    rng = np.random.default_rng(seed)
    pools = {lang: [words for own, words in texts if own == lang] for lang in langs}
    chains = np.empty((SEQUENCES, CHAIN), np.int64)
    labels = np.empty((SEQUENCES, CHAIN), np.int64)
    number: dict[str, int] = {}
    for row in range(SEQUENCES):
        at = 0
        while at < CHAIN:
            label = int(rng.integers(len(langs)))
            pool = pools[langs[label]]
            words = pool[int(rng.integers(len(pool)))]
            run = min(int(rng.integers(4, CHAIN + 1)), CHAIN - at, len(words))
            first = int(rng.integers(len(words) - run + 1))
            chains[row, at : at + run] = [number.setdefault(w, len(number)) for w in words[first : first + run]]
            labels[row, at : at + run] = label
            at += run
    flat, sizes = features(list(number), lexicon)
    ids = np.split(flat, np.cumsum(sizes)[:-1])
    model = Field(langs, np.zeros((BUCKETS, len(langs))), np.zeros((len(langs), len(langs))), lexicon)
    pace, pace_moves = np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1e-6)
    eye = np.eye(len(langs))
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(SEQUENCES), max(1, SEQUENCES // 64)):
            used, inverse = np.unique(chains[rows], return_inverse=True)
            sizes = np.array([len(ids[u]) for u in used])
            flat = np.concatenate([ids[u] for u in used])
            starts = np.cumsum(sizes) - sizes
            per_word = np.add.reduceat(model.weights[flat], starts, axis=0) / np.sqrt(sizes)[:, None]
            scores = per_word[inverse.ravel()].reshape(len(rows), CHAIN, -1)
            wanted = eye[labels[rows]]
            seen, pairs = expectations(scores, model.moves)
            gap = np.zeros((len(used), len(langs)))
            np.add.at(gap, inverse.ravel(), (wanted - seen).reshape(-1, len(langs)))
            gap = np.repeat(gap / np.sqrt(sizes)[:, None], sizes, axis=0)
            grad = np.stack([np.bincount(flat, gap[:, k], BUCKETS) for k in range(len(langs))], axis=1)
            grad = grad / len(rows) - 1e-4 * model.weights
            pace += grad**2
            model.weights += 0.5 * grad / np.sqrt(pace)
            move = (np.einsum("bti,btj->ij", wanted[:, :-1], wanted[:, 1:]) - pairs) / len(rows) - 1e-3 * model.moves
            pace_moves += move**2
            model.moves += 0.2 * move / np.sqrt(pace_moves)
    model.weights = model.weights.astype(np.float32)
    return model


def expectations(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of a block of equally long chains and the summed pair expectations."""
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    step, size = np.exp(moves), scores.shape[1]
    ahead, back = np.empty_like(local), np.ones_like(local)
    ahead[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, size):
        now = (ahead[:, t - 1] @ step) * local[:, t]
        ahead[:, t] = now / now.sum(axis=1, keepdims=True)
    for t in range(size - 2, -1, -1):
        now = (back[:, t + 1] * local[:, t + 1]) @ step.T
        back[:, t] = now / now.sum(axis=1, keepdims=True)
    single = ahead * back
    single /= single.sum(axis=2, keepdims=True)
    joint = ahead[:, :-1, :, None] * step * (back[:, 1:] * local[:, 1:])[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return single, joint.sum(axis=(0, 1))


def training_sample(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_lang: int = DOCS_PER_LANG, seed: int = 11
) -> list[tuple[str, bytes]]:
    """At most ``per_lang`` labelled texts per language, chosen by a hash of the text.

    Counts come first, from the label column alone; they give the share of each language that can be
    in the sample, so few texts are moved however large the table is.
    """
    known = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text")).where(
        "lang is not null and text is not null"
    )
    counts = known.groupBy("lang").count().collect()  # a row per language; the model has weights for each
    if not counts:
        return []
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(4.0 * per_lang / r["count"]))])
    near = known.withColumn("place", F.xxhash64(F.lit(seed), F.col("text"))).where(
        F.pmod("place", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    rows = near.withColumn("rank", rank).where(F.col("rank") <= per_lang)
    return [(r["lang"], bytes(r["text"])) for r in rows.select("lang", F.col("text").cast("binary").alias("text")).collect()]


class Emissions:
    """Emissions of words, remembered for the words met lately."""

    def __init__(self, model: Field):
        self.model = model
        self.places: dict[str, int] = {}
        self.table = np.empty((CACHE_WORDS + SLICE, len(model.langs) + 1), np.float32)

    def of(self, words: Sequence[str]) -> np.ndarray:
        out = np.empty((len(words), self.table.shape[1]), np.float32)
        for at in range(0, len(words), SLICE):
            part = words[at : at + SLICE]
            fresh = sorted(set(part).difference(self.places))
            if fresh:
                if len(self.places) + len(fresh) > len(self.table):
                    self.places.clear()
                    fresh = sorted(set(part))
                first = len(self.places)
                self.places.update(zip(fresh, range(first, first + len(fresh)), strict=True))
                self.table[first : first + len(fresh)] = self.model.emissions(fresh)
            out[at : at + len(part)] = self.table[[self.places[w] for w in part]]
        return out


def tagger(model: Field | None, finish):
    """Chunk function: words, posteriors and evidence (share of features seen in training) of each text, given to
    ``finish(text, words, posteriors, evidence)``.

    Texts are taken in groups of ``GROUP_WORDS`` words, so what is held at once does not depend on what the words are.
    """

    def start():
        emissions = Emissions(model) if model else None

        def group(texts, split):
            sizes = np.array([len(words) for words in split if words], np.int64)
            parts = iter(())
            if len(sizes):
                scores = emissions.of([w for words in split for w in words])
                cuts = np.cumsum(sizes)[:-1]
                found = model.posteriors(scores[:, :-1], sizes)
                parts = iter(zip(np.split(found, cuts), np.split(scores[:, -1], cuts), strict=True))
            for text, words in zip(texts, split, strict=True):
                yield finish(text, words, *(next(parts) if words else (None, None)))

        def work(texts):
            made, held, split, count = [], [], [], 0
            for text in texts:
                words = words_of(text) if model else []
                if held and count + len(words) > GROUP_WORDS:
                    made.extend(group(held, split))
                    held, split, count = [], [], 0
                held.append(text)
                split.append(words)
                count += len(words)
            made.extend(group(held, split))
            return [list(column) for column in zip(*made, strict=True)]

        return work

    return start


def identify(
    docs: DataFrame, model: Field | None, *, text_col: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the mean posterior of that language over all words) and ``evidence`` (the
    mean share of the words' features that training has seen in any language)."""

    def finish(text, words, posterior, evidence):
        if posterior is None:
            return UNKNOWN, 0.0, 0.0
        mean = posterior.mean(axis=0, dtype=np.float64)
        best = int(mean.argmax())
        return model.langs[best], min(1.0, float(mean[best])), float(evidence.mean(dtype=np.float64))

    fields = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType()),
    ]
    return add_columns(docs, [text_col], fields, tagger(model, finish), keep, CHUNK_BYTES)


def label_words(
    docs: DataFrame, model: Field | None, *, text_col: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` with ``words``: start, end (code points), language and posterior of every word."""

    def finish(text, words, posterior, _):
        if posterior is None:
            return ([],)
        original = text.decode("utf-8", "replace")
        places = [m.span() for m in WORD.finditer(original)]
        if len(places) != len(words):  # lower-casing changed the length of a word's letters
            places = [(None, None)] * len(words)
        best = posterior.argmax(axis=1)
        return ([
            {"start": a, "end": b, "lang": model.langs[k], "posterior": float(p[k])}
            for (a, b), k, p in zip(places, best, posterior, strict=True)
        ],)

    word = T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("lang", T.StringType()), T.StructField("posterior", T.DoubleType()),
    ])
    return add_columns(docs, [text_col], [T.StructField("words", T.ArrayType(word))], tagger(model, finish), keep, CHUNK_BYTES)


def keep_identified(docs: DataFrame, model: Field | None, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with letters whose words look like any known language, columns as they came.

    ``least`` is the mean share of known features a text needs; how the languages share a text does not matter,
    so code-switched and short texts stay.
    """
    plain, back = plain_names(docs, text=text_col)
    found = identify(plain, model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("evidence") >= least)).select(*back)
