"""Registered queries of the training-data operators: each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlens.llm import ann, decontam, dialogue, html, langid, lmscore, mixing, pieces, pii, quality, ranked, secrets, simhash
from voltlens.llm.common import read_table
from voltlens.llm.oracle import LLM_SQL as LLM_SQL

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(query):
    LLM_QUERIES[query.__name__] = query
    return query


@register
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its secrets."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    table = secrets.train(secrets.default_samples(docs))
    return secrets.report(secrets.find_secrets(docs, table), ["doc_id"])


@register
def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data and the terms that give it away."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return pii.report(pii.find_personal(docs), ["doc_id"])


@register
def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the words the mix takes of it."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs.select("doc_id", "text", "source")).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies"
    )


@register
def op4_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its fingerprint and near-duplicate class."""
    found = simhash.near_duplicates(read_table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register
def op5_cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its losses under the models of good documents and of all documents."""
    good = read_table(spark, folder, "labels").where("quality = 1")
    return lmscore.score(read_table(spark, folder, "documents"), good)


@register
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the predicted language; documents of remainder 2 are held out."""
    place = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("place", place)
    model = langid.fit(langid.training_sample(docs.where("place <> 2")))
    marked = docs.select("doc_id", "text", F.coalesce(F.col("place") == 2, F.lit(False)).alias("held_out"))
    return langid.identify(marked, model, keep=["doc_id", "held_out"])


@register
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its quality score; documents of remainder 1 are held out."""
    place = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = read_table(spark, folder, "labels").where(place != 1)
    scored = quality.score_quality(read_table(spark, folder, "documents"), labels)
    return scored.select(
        "doc_id", F.coalesce(place == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@register
def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    index = ann.build(read_table(spark, folder, "embeddings"))
    return ann.search(index, index.rows.where("vec_id % 50 = 0"))


@register
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the benchmark passages in it."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = decontam.scan_documents(docs, read_table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@register
def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its title and visible text."""
    return html.extract(read_table(spark, folder, "pages"), keep=["page_id", "url"])


@register
def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded with the public vocabulary of 32,000 pieces."""
    import public_tokenizers

    words = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.round_trip(read_table(spark, folder, "documents"), words, keep=["doc_id"])


@register
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, damaged and repaired by the cheapest edits."""
    return dialogue.repair(dialogue.damage(read_table(spark, folder, "conversations")))


@register
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return ranked.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
