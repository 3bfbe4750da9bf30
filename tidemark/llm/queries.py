"""Registered queries of the subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.apportion import mix_to_targets, mixing_sql
from tidemark.llm.conversation_repair import damage, repair, repair_sql
from tidemark.llm.licence_dice import licence_scan, licence_sql
from tidemark.llm.prefix_join import contamination, contamination_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is left out where plain SQL cannot express it."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the 50k byte-level vocabulary."""
    import public_tokenizers

    from tidemark.llm.bpe_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_scaled_sketch")
def op4_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    from tidemark.llm.scaled_sketch import neighbour_fingerprints

    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


@query("op5_source_mix", sql=f"WITH {mixing_sql()}\nSELECT * EXCLUDE (source) FROM mixed")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_to_targets(table(spark, sf_dir, "documents")).drop("source")


@query("op10_decontamination", sql=f"WITH {contamination_sql()}\nSELECT * EXCLUDE (items), sha256(items) AS items_sha256 FROM contaminated_docs")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows cover."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2("items", 256)).drop("items")


@query("op9_page_template")
def op9_page_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from tidemark.llm.page_template import extract

    return extract(table(spark, sf_dir, "pages"))


def held_out(id_col: str, folds: int) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by `folds`; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 2, F.lit(False))


@query("op2_multi_instance_toxicity")
def op2_multi_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of three folds of four."""
    from tidemark.llm import multi_instance

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = multi_instance.train(docs, labels.where(~held_out("doc_id", 4)))
    scored = multi_instance.scores(docs, model)
    return scored.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that an earlier document has."""
    from tidemark.llm.super_kmers import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op7_near_duplicates")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 80 % of their two-word shingles in common."""
    from tidemark.llm.bottom_k import similar_components

    return similar_components(table(spark, sf_dir, "documents"), shingle_words=2)


@query("op1_brown_scores")
def op1_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a class bigram model of six folds of seven."""
    from tidemark.llm import brown

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = brown.score(docs, brown.train(docs.where(~held_out("doc_id", 7))))
    return scored.select("doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_licence_scan", sql=licence_sql())
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document declares."""
    return licence_scan(table(spark, sf_dir, "documents"))


@query("op11_addressable_codes")
def op11_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and identifiers, read back from directly addressable codes."""
    import uuid

    import public_tokenizers

    from tidemark.llm.addressable_codes import read_documents, write_codes
    from tidemark.sources.staging import leave_with_session, shared_dir

    folder = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
    write_codes(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    leave_with_session(spark, folder)
    return read_documents(spark, folder)


@query("op12_conversation_repair", sql=repair_sql())
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    return repair(damage(table(spark, sf_dir, "conversations")))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of every document under two vocabularies."""
    import public_tokenizers

    from tidemark.llm.token_alignment import alignment

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
