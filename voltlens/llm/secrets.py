"""Secret scans with DataFrame functions: fixed forms and two character Markov models.

Fixed forms: assignments of a password, token or key, access key ids, long hexadecimal strings.  Beyond
them every run of ``CANDIDATE`` letters is judged by two first-order Markov models over characters, one
of random strings and one of ordinary identifiers: the run is a secret if the log-likelihood ratio
favours the random one by ``LEAST_TOTAL`` in all and by ``LEAST_EACH`` per transition; runs of fewer than
``LEAST_LETTERS`` different characters (rules, padding) are neither.

The models are counted from labelled samples, a table of (value, random).  The default sample takes the
values that the fixed forms find in about ``SAMPLE_DOCS`` documents chosen by hash (all, if there are
no more), made-up keys in usual alphabets (digests of a counter), and as ordinary the words of these documents.
The ratios of all pairs of ASCII characters are one array literal of thousandths of a nat, so sums are
exact and do not depend on order.

Cases: null and empty texts have no spans; without samples the models are uniform and add nothing;
spans of the models that touch a fixed one are left out; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlens.llm.spans import Kind, add_spans, let, listing, masked, tagged

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE = (
    Kind("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z0-9_]{6,}"
SAMPLE_DOCS = 4000
MADE_UP = 2000
SCALE = 1000
LEAST_TOTAL = 12 * SCALE
LEAST_EACH = SCALE // 2
LEAST_LETTERS = 8
KINDS = ("assign", "access", "hex", "markov")


def default_samples(docs: DataFrame, *, text_col: str = "text", limit: int = SAMPLE_DOCS, seed: int = 13) -> DataFrame:
    """Labelled samples ``(value, random)`` from a bounded number of documents and made-up keys."""
    spark = docs.sparkSession
    texts = docs.select(docs[text_col].alias("text")).where("text is not null")
    count = texts.count()
    place = F.xxhash64(F.lit(seed), F.col("text"))
    picked = texts.where(F.pmod(place, F.lit(1_000_000)) < F.lit(1_000_000.0 * limit / max(1, count))).distinct()
    found = add_spans(picked, "text", BASE)
    value = F.concat(
        F.transform("assign", lambda s: F.regexp_extract(s["hit"], ASSIGN, 2)),
        F.transform("access", lambda s: s["hit"]), F.transform("hex", lambda s: s["hit"]),
    )
    secrets = found.select(F.explode(value).alias("value"))
    rest = found
    for k in BASE:
        rest = rest.withColumn("text", F.regexp_replace("text", k.pattern, " "))
    words = rest.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("value"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    keys = spark.range(MADE_UP).select(F.explode(F.array(
        F.base64(F.unhex(digest)), F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 32)),
        F.translate(F.base64(F.unhex(F.substring(digest, 5, 48))), "+/=", ""),
    )).alias("value"))
    return secrets.union(keys).select("value", F.lit(True).alias("random")).union(
        words.select("value", F.lit(False).alias("random"))
    )


def train(samples: DataFrame) -> list[int]:
    """Log-likelihood ratios (random over ordinary) of all 128 x 128 transitions, in thousandths of a nat.

    Add-one smoothing over the characters seen in any sample; other transitions count nothing.
    """
    pairs = (
        samples.where(F.length("value") > 1)
        .select("random", F.split("value", "").alias("c"))
        .select("random", F.explode(F.transform(
            F.sequence(F.lit(0), F.size("c") - 2),
            lambda i: F.struct(F.ascii(F.col("c")[i]).alias("a"), F.ascii(F.col("c")[i + 1]).alias("b")))).alias("p"))
        .where("p.a between 1 and 127 and p.b between 1 and 127")
    )
    rows = pairs.groupBy("p.a", "p.b").agg(
        F.count_if("random").alias("random"), F.count_if(~F.col("random")).alias("plain")
    ).collect()  # at most 128 x 128 rows
    letters = {r["a"] for r in rows} | {r["b"] for r in rows}
    sums: dict[tuple[str, int], int] = {}
    counts = {}
    for r in rows:
        for kind in ("random", "plain"):
            counts[kind, r["a"], r["b"]] = r[kind]
            sums[kind, r["a"]] = sums.get((kind, r["a"]), 0) + r[kind]
    from math import log

    table = [0] * (128 * 128)
    for a in letters:
        for b in letters:
            chance = [
                log((counts.get((kind, a, b), 0) + 1) / (sums.get((kind, a), 0) + len(letters)))
                for kind in ("random", "plain")
            ]
            table[a * 128 + b] = round(SCALE * (chance[0] - chance[1]))
    return table


def ratio(token: Column, table: Sequence[int]) -> Column:
    """Log-likelihood ratio of an ASCII token, summed over its transitions."""
    cells = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # folded to one literal
    codes = F.transform(F.split(token, ""), F.ascii)
    return let(codes, lambda c: F.aggregate(
        F.sequence(F.lit(1), F.size(c) - 1), F.lit(0).cast("bigint"),
        lambda s, i: s + F.get(cells, c[i - 1] * 128 + c[i])))


def find_secrets(docs: DataFrame, table: Sequence[int], *, text_col: str = "text") -> DataFrame:
    """``docs`` with arrays of spans (start, end, hit) named assign, access, hex and markov."""
    transitions = lambda m: F.length(m) - 1

    def random_looking(m: Column) -> Column:
        varied = F.size(F.array_distinct(F.split(m, ""))) >= LEAST_LETTERS
        return let(ratio(m, table), lambda r: (r >= LEAST_TOTAL) & (r >= LEAST_EACH * transitions(m)) & varied)

    found = add_spans(docs, text_col, [*BASE, Kind("markov", CANDIDATE)])
    fixed = F.concat("assign", "access", "hex")
    free = F.filter("markov", lambda m: ~F.exists(fixed, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return found.withColumn("markov", F.when(F.size("markov") > 0, F.filter(free, lambda s: random_looking(s["hit"]))).otherwise(F.col("markov")))


def report(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts and listings of the spans that ``find_secrets`` added."""
    base = listing(tagged(KINDS[:3]), by_kind=False)
    return found.select(
        *columns,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        listing(tagged(KINDS), by_kind=False).alias("spans"),
    )


def redact(docs: DataFrame, table: Sequence[int], *, text_col: str = "text", mask: str = "<secret>") -> DataFrame:
    """``docs``, columns as they came, with every secret in the text replaced by ``mask``.

    A column ``n_chars`` follows the new text where it changed.
    """
    packed = docs.select(docs[text_col].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    found = find_secrets(packed, table)
    spans = F.transform(tagged(KINDS), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mask).alias("mask")))
    new = found.select("row", masked(F.col("text"), spans).alias("new"), (F.size(spans) > 0).alias("changed"))
    columns = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == text_col:
            value = F.col("new")
        elif c == "n_chars":
            value = F.when(F.col("changed"), F.length("new").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return new.select(*columns)
