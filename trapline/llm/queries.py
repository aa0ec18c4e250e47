"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, vector_codes, warc
from .common import table

#: The rules that op2 is asked for.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

#: The share of each window that op5 and the pipeline give a source; the other sources share the rest.
MIXTURE = {"src0": 0.1}


def word_bpe() -> str:
    """Path of the public word-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source`` is the host and ``lang`` the path below it."""
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled urls are pages whose number is a labelled document's: low quality is to block."""
    from .url_filter import fit, judge

    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).cast("int").alias("label"))
    numbered = pages.select("url", F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)").alias("doc_id"))
    return judge(pages, URL_RULES, fit(numbered.join(labels, "doc_id").select("url", "label")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), word_bpe(), mixture=MIXTURE)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id")))
    return identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record, found by its url in the index and read from its archive by range."""
    pages = table(spark, sf_dir, "pages")
    read = warc.fetch(warc.archive_pages(pages).lookup(pages))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return read.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .windows import remove_windows

    return remove_windows(table(spark, sf_dir, "documents")).drop("kept")


def queries() -> dict:
    found = [
        op1_quality, op2_url_filter, op3_decontaminate, op4_line_dedup, op5_pack, op6_substrings, op7_exact_dedup, op8_language, op9_simhash, op10_warc,
        op11_filter_audit, op12_vector_codes, op13_windows,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact_dedup.ORACLE, "op10_warc": warc.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op12_vector_codes": vector_codes.oracle()}
