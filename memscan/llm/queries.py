"""The registered queries of the subpackage: thin digests of its operators."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memscan.llm import (bpe, common, katz, langid, license, linededup, merkle, neardup, oracle, packing, repeats, runs,
                         sharding, vectors)
from memscan.llm.quality import quality


def _documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    common.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cols)


def vocabulary_file(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text and decode it again."""
    return bpe.round_trip_digests(_documents(spark, sf_dir, "doc_id", "text"), vocabulary_file("byte_bpe_50k.json"))


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with the line kept for its component."""
    c = linededup.line_classes(_documents(spark, sf_dir, "doc_id", "text"))
    return c.select("doc_id", "line_no", "n_chars", "rep_doc_id", "rep_line_no", "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every whole text."""
    return license.scan(_documents(spark, sf_dir, "doc_id", "text"))


def op4_pack_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(_documents(spark, sf_dir, "doc_id", "text"), vocabulary_file("word_bpe_49k.json"))


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff scores of every whole text, learned from six sevenths."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return katz.katz_scores(_documents(spark, sf_dir, "doc_id", "text"), part == 2)


def op6_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    common.prepare(spark)
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op7_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from two thirds of the rows."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return langid.identify(_documents(spark, sf_dir, "doc_id", "text", "lang"), part != 1, part == 1)


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over every whole text: base counts, distances, verdict."""
    d = _documents(spark, sf_dir, "doc_id", "text", "lang")
    q = quality(d, stage=lambda h: common.stage(h.drop("text"), "quality"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "class_distance", "common_distance")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return neardup.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"))


def op10_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that start earlier."""
    return repeats.without_repeats(_documents(spark, sf_dir, "doc_id", "text")).drop("kept")


def op11_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 24 shards of near-equal bytes."""
    return sharding.shard_documents(_documents(spark, sf_dir, "doc_id", "text"), 24)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root, verified after some texts were changed."""
    docs = _documents(spark, sf_dir, *merkle.FIELDS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = merkle.leaf_digest([F.translate("text", upper, upper.lower()) if c == "text" else F.col(c)
                                   for c in merkle.FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = common.stage(merkle.leaf_rows(docs, {"tampered": F.when(hit, tampered)}), "merkle-leaf-rows")
    p = merkle.proofs(merkle.manifest(leaves, ["id", "tampered"]))
    folded = merkle.fold(F.coalesce("member.tampered", "member.digest"), F.col("proof"))
    h = merkle.hex_of
    return (p.select(F.col("member.id").alias("doc_id"), h(F.col("member.digest")).alias("leaf"),
                     h(F.col("subroot")).alias("subroot"), h(F.col("root")).alias("root"),
                     merkle.proof_digest(F.col("proof")).alias("proof_sha256"), h(folded).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def copied_tails(ids: list, counts: np.ndarray) -> np.ndarray:
    """The word to read at each place: in a tenth of the texts the words from
    some place on repeat those before them, with a period of their own."""
    index = np.arange(int(counts.sum()))
    for doc, n, at in zip(ids, counts.tolist(), (np.cumsum(counts) - counts).tolist(), strict=True):
        h = 1 if doc is None else zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            period = 1 + (n - a) // (3 + g % 8)
            index[at + a:at + n] = at + a + np.arange(n - a) % period
    return index


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every whole text, some with copied tails."""
    return runs.run_digests(_documents(spark, sf_dir, "doc_id", "text"), copied_tails)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline (corpus_pipeline.py) over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_bpe_round_trip": op1_bpe_round_trip,
        "op2_fuzzy_lines": op2_fuzzy_lines,
        "op3_license_scan": op3_license_scan,
        "op4_pack_histogram": op4_pack_histogram,
        "op5_katz_backoff": op5_katz_backoff,
        "op6_pivot_permutation": op6_pivot_permutation,
        "op7_language_kernel": op7_language_kernel,
        "op8_quality_divergence": op8_quality_divergence,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_maximal_repeats": op10_maximal_repeats,
        "op11_virtual_slots": op11_virtual_slots,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.queries()
