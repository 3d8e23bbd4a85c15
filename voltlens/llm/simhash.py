"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits come from word shingles (bit set where it is set in over half the shingle
hashes, repeats counted).  Two fingerprints are linked at ``MAX_BITS`` = 2 or fewer differing bits.

Search: each distinct fingerprint is filed in two tables, by its high and by its low 32 bits.  Of
two fingerprints at distance 2 or less, either the high halves differ in at most one bit or the low
halves are equal.  So each fingerprint looks up the ball of radius 1 around its high half and its
own low half; pairs that differ in one bit of the half need one look-up only, from the side that
has the bit set.  Matches are verified on all 64 bits.

Buckets with more than ``bucket_rows`` entries would give a square of candidates.  Everything that
touches such a bucket is linked in another exact way: two fingerprints are at distance 2 or less
just if their balls of radius 1 share a point, so grouping by the 65 points of each ball and
linking each member to the smallest one of the point gives the same components with a linear
number of rows.  No link is lost.

Copies of a fingerprint meet only in a map-side combined aggregate.  Cases: null and empty texts
have fingerprint zero and are linked like any other; repeated rows get the same class; a missing id
never becomes a class id unless its whole class has none.

The stage of the pipeline (``keep_one_per_similar``) has a setting of its own: texts are linked at a Jaccard
similarity of ``SIMILAR`` = 0.8 or more of their sets of five-word shingles.  The search above goes first: fingerprints of
the five-word shingles within ``MAX_BITS`` give pairs (``print_pairs``), each judged by its exact sets.  A Hamming radius that
takes in all of 0.8 is too wide to search, so for texts that it does not join candidates come from ``BANDS`` bands of ``BAND`` minima of hashed shingles, and every candidate is judged by
its exact shingle sets (64-bit hashes of shingles).  A pair of similarity 0.8 shares no band with probability
(1 - 0.8^5)^32 = 3e-6, a closer one less often.  The members of a band are first judged against one of them, so a large
group of near copies does not give its square of pairs: each text against the lead of its largest band, then against the
leads of its other bands as far as it is not joined to them.  Texts that then still share a band with others they are not
joined to are compared by their rarest shingles (``prefix_pairs``), which misses no pair of 0.8 and spares texts that merely
have common passages.

Before shingle sets meet, sketches do (``can_be_similar``): a bit per value of a hash, set where an odd number of shingles
has it.  The bits in which two sketches differ are at most the shingles that one set has and the other lacks, so a pair with
more of them than a similarity of 0.8 allows is refused for certain, and none of 0.8 or more is.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlens.llm.common import add_columns, chunks, clear_up, plain_names, stored
from voltlens.llm.components import star_edges

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BUCKET_ROWS = 256
BLOCK = 1 << 16
#: Setting of the pipeline stage: words of a shingle, least Jaccard similarity, bands and minima of a band.
WIDE = 5
SIMILAR = (4, 5)
BANDS = 32
BAND = 5
SET_BLOCK = 2048
#: Bytes of shingle sets judged at once, and buckets in which the rarity of shingles is counted.
PAIR_BYTES = 4 << 20
RARITY = 1 << 18
#: Bits of the sketch of a shingle set, in words of 64.
SKETCH = 16 * 64

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < size:
        return xxh64_intdigest(b" ".join(words), seed)
    total = len(words) - size + 1
    shingles = (
        (b"%b %b %b" % s for s in zip(words, words[1:], words[2:]))
        if size == 3
        else (b" ".join(words[i : i + size]) for i in range(total))
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        count = min(BLOCK, total - at)
        hashes = np.fromiter((xxh64_intdigest(s, seed) for s in islice(shingles, count)), np.uint64, count)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(count, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def add_fingerprints(
    docs: DataFrame,
    *,
    text_col: str = "text",
    name: str = "fp",
    size: int = SHINGLE,
    seed: int = SEED,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long."""

    def start():
        def work(texts):
            return [[v - (1 << 64) if v >> 63 else v for v in (fingerprint(t, size, seed) for t in texts)]]

        return work

    return add_columns(docs, [text_col], [T.StructField(name, T.LongType())], start, keep)


def links(prints: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``) that give the classes.

    Every pair within ``MAX_BITS`` is either an edge or joined through edges to a common member.
    """
    halves = prints.select(
        "fp", F.shiftrightunsigned("fp", 32).alias("hi"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("lo")
    )
    low_mark = F.lit(1 << 32)
    table = halves.select("fp", F.explode(F.array("hi", F.col("lo") + low_mark)).alias("key"))
    ball = F.expr("transform(filter(sequence(0, 31), i -> getbit(hi, i) = 1), i -> hi - shiftleft(1L, i))")
    probes = halves.select(
        "fp", F.posexplode(F.concat(F.array("hi", F.col("lo") + low_mark), ball)).alias("i", "key")
    ).select("fp", "key", (F.col("i") < 2).alias("own"))

    crowded = table.groupBy("key").count().where(F.col("count") > bucket_rows).select("key")
    calm = table.join(crowded, "key", "left_anti").select("key", F.col("fp").alias("b"))
    pairs = (
        probes.withColumnRenamed("fp", "a").join(crowded, "key", "left_anti").join(calm, "key")
        .where((~F.col("own") | (F.col("a") < F.col("b"))))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        .select("a", "b")
    )
    crowd = probes.join(crowded, "key", "left_semi").select("fp").distinct()
    points = crowd.select(
        "fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("point")
    )
    first = (
        points.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("last"))
        .where("b < last").select("point", "b")
    )
    stars = points.join(first, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars)


def classes(prints: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, fp)`` -> one row per distinct fingerprint: ``fp``, ``root`` and ``low`` (its smallest id)."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = star_edges(links(distinct, bucket_rows))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low"
    )


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (long), ``component_id`` (smallest id of its class)."""
    prints = stored(
        add_fingerprints(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), keep=["doc_id"]),
        "prints",
    )
    known = stored(classes(prints, bucket_rows), "classes")
    ids = known.groupBy("root").agg(F.min("low").alias("component_id"))
    found = known.join(ids, "root").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one_per_class(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``docs`` reduced to one row per class: the one with the smallest id (missing ids last).

    Rows that repeat id and fingerprint leave one row, the first by the hash of all columns.
    """
    plain, back = plain_names(docs, doc_id=id_col, text=text_col)
    prints = stored(add_fingerprints(plain, keep=["doc_id"]), "prints")
    known = stored(classes(prints, bucket_rows), "classes")
    return winners(add_fingerprints(plain).select("doc_id", "fp", F.struct(*back).alias("row")), known)


def winners(rows: DataFrame, known: DataFrame) -> DataFrame:
    """One of ``rows`` (``doc_id``, ``row``, ``fp``) per class of ``known``."""
    winner = F.min(F.struct(F.col("low").isNull().alias("none"), F.col("low"), F.col("fp"))).alias("w")
    kept = known.groupBy("root").agg(winner).select(F.col("w.low").alias("low"), F.col("w.fp").alias("wfp"))
    chosen = rows.join(kept, (rows["fp"] == kept["wfp"]) & rows["doc_id"].eqNullSafe(kept["low"]), "left_semi")
    first = F.min_by("row", F.xxhash64("row")).alias("row")
    return chosen.groupBy("fp", "doc_id").agg(first).select("row.*")


def shingle_set(text: bytes | None, size: int = WIDE, seed: int = SEED) -> np.ndarray:
    """Distinct hashes of the shingles of a text, ascending; a shorter text is one shingle, none without words."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    shingles = (b" ".join(s) for s in zip(*(words[i:] for i in range(min(size, len(words)))), strict=False))
    return np.unique(np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64))


def set_id(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    v = xxh64_intdigest(hashes.tobytes(), SEED)
    return v - (1 << 64) if v >> 63 else v


def sketch(hashes: np.ndarray) -> list[int]:
    """Parity of the number of hashes per value of their low bits, as signed 64-bit words."""
    odd = np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def can_be_similar(size_a: Column, size_b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """False only for pairs below ``SIMILAR``: by sizes, and by the least number of shingles in just one of the two sets.

    With n shingles in both and h in just one, the similarity is (n - h) / (n + h).
    """
    up, down = SIMILAR
    apart = sum((F.bit_count(sketch_a[i].bitwiseXOR(sketch_b[i])) for i in range(SKETCH // 64)), F.lit(0))
    sizes = down * F.least(size_a, size_b) >= up * F.greatest(size_a, size_b)
    return sizes & ((down + up) * apart <= (down - up) * (size_a + size_b))


def print_of(hashes: np.ndarray) -> int:
    """SimHash fingerprint of a shingle set, as a signed long: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SET_BLOCK):
        part = hashes[at : at + SET_BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def add_sets(docs: DataFrame, what: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``fp``, the hash of the shingle set of ``text``, and its ``bands`` and fingerprint ``mark`` or its ``shingles`` and ``sketch``, both with the set's ``size``."""

    def start():
        rng = np.random.default_rng(SEED)
        times = rng.integers(1, 1 << 63, BANDS * BAND, dtype=np.uint64) | np.uint64(1)
        fold = rng.integers(1, 1 << 63, (BANDS, BAND), dtype=np.uint64) | np.uint64(1)

        def bands(hashes):
            if not len(hashes):
                return []
            least = np.full(BANDS * BAND, ~np.uint64(0))
            for at in range(0, len(hashes), SET_BLOCK):
                np.minimum(least, (hashes[at : at + SET_BLOCK, None] * times).min(axis=0), out=least)
            return (least.reshape(BANDS, BAND) * fold).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()

        def work(texts):
            sets = [shingle_set(t) for t in texts]
            more = {"bands": lambda: [[len(s) for s in sets], [print_of(s) for s in sets], [bands(s) for s in sets]],
                    "shingles": lambda: [[len(s) for s in sets], [sketch(s) for s in sets], [s.tobytes() for s in sets]]}
            return [[set_id(s) for s in sets], *(more[what]() if what else [])]

        return work

    size, longs = T.StructField("size", T.LongType()), T.ArrayType(T.LongType())
    fields = {"bands": [size, T.StructField("mark", T.LongType()), T.StructField("bands", longs)],
              "shingles": [size, T.StructField("sketch", longs), T.StructField("shingles", T.BinaryType())]}
    return add_columns(docs, ["text"], [T.StructField("fp", T.LongType()), *fields.get(what, [])], start, keep)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose shingle sets have a Jaccard similarity of ``SIMILAR`` or more."""
    up, down = SIMILAR

    def judge(batches):
        for batch in (part for whole in batches for part in chunks(whole, [2, 3], PAIR_BYTES)):
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            good = []
            for i, (one, two) in enumerate(zip(x, y, strict=True)):
                n = (len(one) + len(two)) // 8
                if down * min(len(one), len(two)) >= up * max(len(one), len(two)):
                    one, two = np.frombuffer(one, "<u8"), np.frombuffer(two, "<u8")
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if down * both >= up * (n - both):
                        good.append(i)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    first = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that sizes and sketches do not refuse."""
    first, second = (sets.select(F.col("fp").alias(c), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch")) for c in "ab")
    met = pairs.join(first, "a").join(second, "b")
    return met.where(can_be_similar(*(met[f"{c}_{what}"] for what in ("size", "sketch") for c in "ab"))).select("a", "b")


def prefix_pairs(open_: DataFrame) -> DataFrame:
    """Pairs of different roots that can be similar: of ``fp, root, sketch, shingles``, at least all pairs of ``SIMILAR``.

    Shingles are put in one order, rare ones first.  Two sets of similarity 4/5 share a shingle among the first
    fifth (and one) of each, so it is enough to look for common shingles there; texts that only have common passages
    in common do not meet, and of those that meet sketches refuse most that are below.  Rarity is counted in ``RARITY`` buckets, a table of bounded size; any order is right.
    """
    up, down = SIMILAR

    def tally(batches):
        seen = np.zeros(RARITY, np.int64)
        for batch in batches:
            for value in batch.column(0):
                seen += np.bincount(np.frombuffer(value.as_buffer(), "<u8") & np.uint64(RARITY - 1), minlength=RARITY)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(seen[used], pa.int64())], names=["bucket", "n"])

    counted = open_.select("shingles").mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # RARITY rows at most
    rarity = np.zeros(RARITY, np.int64)
    rarity[found.column("bucket").to_numpy()] = found.column("n").to_numpy()

    def first(batches):
        for batch in batches:
            for part in chunks(batch, [3], PAIR_BYTES):
                rows, shingles, sizes = [], [], []
                for at, value in enumerate(part.column(3)):
                    own = np.frombuffer(value.as_buffer(), "<u8")
                    size = len(own) - -(-up * len(own) // down) + 1
                    order = np.lexsort((own, rarity[own & np.uint64(RARITY - 1)]))[:size]
                    shingles.append(own[order].view(np.int64))
                    rows.append(np.full(len(order), at))
                    sizes.append(np.full(len(order), len(own)))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).take(at) for i in range(3)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(shingles))],
                    names=["fp", "root", "sketch", "size", "shingle"])

    prefixes = stored(
        open_.select("fp", "root", "sketch", "shingles").where(F.octet_length("shingles") > 0)
        .mapInArrow(first, "fp long, root long, sketch array<long>, size long, shingle long"), "prefixes")
    meeting = prefixes.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("shingle")
    left = prefixes.join(meeting, "shingle", "left_semi")
    right = left.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("fp", "root", "size", "sketch")])
    return left.join(right, "shingle").where(
        (F.col("fp") < F.col("fp_b")) & (F.col("root") != F.col("root_b"))
        & can_be_similar(*(F.col(c) for c in ("size", "size_b", "sketch", "sketch_b")))
    ).select(F.col("fp").alias("a"), F.col("fp_b").alias("b"))


def print_pairs(marked: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs (a, b) of the shingle sets ``fp`` by their fingerprints ``mark``: equal ones with one of them, those within ``MAX_BITS`` by ``links``."""
    first = stored(marked.groupBy("mark").agg(F.min("fp").alias("lead")), "marks")
    equal = marked.join(first, "mark").where("fp <> lead").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
    near = links(first.select(F.col("mark").alias("fp")), bucket_rows)
    of_a, of_b = (first.select(F.col("mark").alias(c), F.col("lead").alias(f"{c}_fp")) for c in "ab")
    return equal.union(near.join(of_a, "a").join(of_b, "b").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))).distinct()


def similar_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> one row per distinct shingle set: ``fp``, ``root`` and ``low`` (its smallest id)."""
    prints = stored(add_sets(docs, "bands", ["doc_id"]), "sets")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    entries = prints.groupBy("fp", "size").agg(F.first("bands").alias("bands")).select("fp", "size", F.posexplode("bands").alias("i", "band"))
    entries = entries.select(F.xxhash64("i", "band").alias("key"), "fp", "size")
    # Another member of each band leads, so that no text leads the bands of a whole group.
    lead = entries.groupBy("key").agg(F.min_by("fp", F.xxhash64("fp", "key")).alias("lead"), F.count("*").alias("n"))
    shared = stored(entries.join(lead.where("n > 1"), "key"), "bands")
    marked = prints.where("size > 0").groupBy("fp").agg(F.first("mark").alias("mark"))
    close = stored(print_pairs(marked), "close")
    clear_up(docs.sparkSession)
    asked = shared.select("fp").union(close.select("a")).union(close.select("b")).distinct()
    sets = stored(
        add_sets(docs, "shingles", []).join(asked, "fp", "left_semi")
        .groupBy("fp").agg(*(F.first(c).alias(c) for c in ("size", "sketch", "shingles"))),
        "shingles",
    )
    led = shared.where("fp <> lead").groupBy(F.col("fp").alias("a"), F.col("lead").alias("b")).agg(F.max("n").alias("n"))
    best = led.groupBy("a").agg(F.max(F.struct("n", "b")).alias("best"))
    led = stored(led.join(best, "a").select("a", "b", (F.col("b") == F.col("best.b")).alias("first")), "led")
    clear_up(docs.sparkSession)
    # Each step adds its pairs to the classes known so far, as links between their roots.
    roots = star_edges(similar(sketched(close, sets), sets))
    leading = parted(led.where("first").select("a", "b"), roots)
    roots = stored(star_edges(similar(sketched(leading, sets), sets), roots), "roots")
    others = parted(led.where("not first").select("a", "b"), roots)
    roots = stored(star_edges(similar(sketched(others, sets), sets), roots), "roots")

    # Texts in a band with others that they are not joined to yet; what is left between them is found exactly.
    rooted = shared.join(roots, shared["fp"] == roots["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    open_ = rooted.join(mixed, "key", "left_semi").select("fp", "root").distinct()
    open_ = stored(open_.join(sets, "fp"), "open")
    rest = prefix_pairs(open_).distinct()
    clear_up(docs.sparkSession)
    every = star_edges(similar(rest, sets), roots)
    return distinct.join(every, distinct["fp"] == every["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")


def parted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose texts have different roots so far, each once, the larger first."""
    of_a, of_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    placed = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    apart = placed.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    return apart.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def keep_one_per_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` reduced to one row per class of similar texts, the same one as in ``keep_one_per_class``."""
    plain, back = plain_names(docs, doc_id=id_col, text=text_col)
    known = stored(similar_classes(plain.select("doc_id", "text")), "classes")
    return winners(add_sets(plain).select("doc_id", "fp", F.struct(*back).alias("row")), known)
