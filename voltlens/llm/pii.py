"""Personal data: information-theoretic sanitisation with DataFrame functions.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers in the texts.  Terms
(words of ``TERM_LETTERS`` letters or more) in the documents of an entity may give it away.  How strongly they do is
estimated from co-occurrence over all documents: with n documents, n(e), n(t) and n(e, t) of them holding the
entity, the term and both anywhere,

    disclosure = PMI(e, t) / IC(e) = log(n n(e, t) (1 - DISCOUNT / k) / (n(e) n(t))) / log(n / n(e)),

the share of the information about e that t reveals.  The pair is seen in k different texts; the discount takes
off the more, the fewer they are, so a pair seen once is judged, but not trusted in full.  A term is generalised
from ``GENERALISE`` on and removed from ``REMOVE`` on, in documents that hold the entity.

Entities that stand in exactly the same texts have the same counts with every term.  They form a class and are
judged as one, so a list of thousands of contacts costs its words once, not once per contact.

Texts that are copies are handled once, with their number as weight, and joined back by two text hashes.
Counts per pair, entity and term combine before the shuffle.  Cases: null and empty texts have no spans;
a term inside an entity is not judged; repeated rows and missing ids are fine; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlens.llm.common import stored, text_key
from voltlens.llm.spans import SPAN, Kind, add_spans, listing, masked, tagged

PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of ``m`` pass the Luhn test."""
    values = F.transform(F.split(F.reverse(digits(m)), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def card(m: Column) -> Column:
    return F.when(F.length(digits(m)).between(16, 19), luhn(m)).otherwise(False)


#: The first part of a pattern keeps a long run from being tried at each of its characters; the last
#: repetition is possessive, which changes no match and needs no stack.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", card),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(8, 15)),
)
KINDS = ("email", "ip", "card", "phone", "term")
TERM_LETTERS = 4
TERM = Kind("term", rf"\p{{L}}{{{TERM_LETTERS},}}")
DISCOUNT = 0.5
GENERALISE = 0.7
REMOVE = 0.95
SALTS = 16


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM.pattern), F.lit(0)))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct texts that hold entities: key, ``text``, ``copies``, ``marks`` (start, end, kind, value)."""
    found = add_spans(docs.select(docs[text_col].alias("text")), "text", BASE)

    def named(kind: str) -> Column:
        value = {"email": F.lower, "ip": lambda m: m}.get(kind, digits)
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), value(s["hit"]).alias("value")))

    marks = F.concat(*[named(k.name) for k in BASE])
    return (
        found.select("text", marks.alias("marks")).where(F.size("marks") > 0)
        .groupBy(*text_key(F.col("text")))
        .agg(F.first("text").alias("text"), F.first("marks").alias("marks"), F.count("*").alias("copies"))
    )


CLASS = ["c1", "c2", "n_texts", "n_entity"]


def classes(held: DataFrame) -> DataFrame:
    """One row per text and class of entities in it: key, ``copies``, ``CLASS`` and one ``kind, value`` of the class."""
    named = F.array_distinct(F.transform("marks", lambda m: F.struct(m["kind"].alias("kind"), m["value"].alias("value"))))
    one = held.select("k1", "k2", "copies", F.explode(named).alias("m")).select("k1", "k2", "copies", "m.kind", "m.value")
    alike = one.groupBy("kind", "value").agg(
        F.bit_xor(F.xxhash64("k1", "k2")).alias("c1"), F.bit_xor(F.xxhash64("k2", F.lit(7), "k1")).alias("c2"),
        F.count("*").alias("n_texts"), F.sum("copies").alias("n_entity"))
    return one.join(alike, ["kind", "value"]).groupBy("k1", "k2", "copies", *CLASS).agg(
        F.min(F.struct("kind", "value")).alias("e")).select("k1", "k2", "copies", *CLASS, "e.kind", "e.value")


def surroundings(held: DataFrame) -> DataFrame:
    """One row per text, class and term in the text: key, ``copies``, ``CLASS``, ``kind, value``, ``term``."""
    words = held.select("k1", "k2", terms(F.col("text")).alias("terms"))
    return classes(held).join(words, ["k1", "k2"]).select(
        "k1", "k2", "copies", *CLASS, "kind", "value", F.explode("terms").alias("term"))


def disclosures(docs: DataFrame, near: DataFrame, *, text_col: str = "text", discount: float = DISCOUNT) -> DataFrame:
    """Class (with one ``kind, value`` of it) and ``term`` with the ``disclosure`` that the corpus shows."""
    n = F.lit(float(docs.count()))
    together = near.groupBy(*CLASS, "term").agg(
        F.sum("copies").alias("n_both"), F.count("*").alias("texts"), F.min(F.struct("kind", "value")).alias("e"))
    term = (
        docs.select(F.explode(terms(docs[text_col])).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    )
    both = F.col("n_both") * (1 - F.lit(discount) / F.col("texts"))
    share = F.log(n * both / (F.col("n_entity") * F.col("n_term"))) / F.log(n / F.col("n_entity"))
    return together.join(term, "term").select(
        *CLASS, "e.kind", "e.value", "term", F.when(F.col("n_entity") < n, share).otherwise(0.0).alias("disclosure"))


def disclosing_terms(
    docs: DataFrame, *, text_col: str = "text", threshold: float = GENERALISE, discount: float = DISCOUNT
) -> DataFrame:
    """Per distinct text with such terms: key and ``term``, the spans (start, end, hit, ``disclosure``)."""
    held = stored(entities(docs, text_col), "entities")
    near = surroundings(held)
    strong = disclosures(docs, near, text_col=text_col, discount=discount).where(F.col("disclosure") >= threshold)
    per_text = (
        near.join(strong.drop("kind", "value"), [*CLASS, "term"]).groupBy("k1", "k2", "term")
        .agg(F.max("disclosure").alias("disclosure"))
        .groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("known"))
    )
    marked = add_spans(held.join(per_text, ["k1", "k2"]), "text", [TERM])
    inside = lambda s: F.exists("marks", lambda m: (m["start"] < s["end"]) & (s["start"] < m["end"]))
    hits = F.filter("term", lambda s: F.map_contains_key("known", F.lower(s["hit"])) & ~inside(s))
    return marked.select("k1", "k2", F.transform(hits, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"),
        F.col("known")[F.lower(s["hit"])].alias("disclosure"))).alias("term"))


def find_personal(
    docs: DataFrame, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",), with_text: bool = False, **options
) -> DataFrame:
    """``keep`` (and the text) with arrays of spans: email, ip, card, phone and term."""
    strong = disclosing_terms(docs, text_col=text_col, **options)
    packed = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].alias("text"))
    base = add_spans(packed, "text", BASE).select("row", *(["text"] if with_text else []), *[k.name for k in BASE], *text_key(F.col("text")))
    # Copies of one text may be a third of all rows: they are dealt to salted keys.
    salted = base.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    joined = salted.join(strong.select("*", salts), ["k1", "k2", "salt"], "left").drop("k1", "k2", "salt")
    none = F.array().cast(SPAN.replace(">>", ",disclosure:double>>"))
    return joined.withColumn("term", F.coalesce("term", none))


def report(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts and listings of the spans that ``find_personal`` gives."""
    return found.select(
        *[F.col("row")[c].alias(c) for c in columns],
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listing(tagged(KINDS[:4]), by_kind=True), 256).alias("base_sha256"),
        listing(tagged(KINDS), by_kind=True).alias("spans"),
    )


def sanitise(docs: DataFrame, *, text_col: str = "text", remove: float = REMOVE, **options) -> DataFrame:
    """``docs``, columns as they came: entities become ``<kind>``, disclosing terms ``<term>`` or, from ``remove`` on, nothing."""
    found = find_personal(docs, text_col=text_col, keep=docs.columns, with_text=True, **options)
    fixed = F.transform(tagged(KINDS[:4]), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), s["kind"], F.lit(">")).alias("mask")))
    loose = F.transform("term", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosure"] >= remove, "").otherwise("<term>").alias("mask")))
    new = masked(F.col("text"), F.concat(fixed, loose))
    return found.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
