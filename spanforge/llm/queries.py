"""Registered queries of this subpackage: each applies one operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, flac, langid, licenses, lm_scoring, maxscore, minhash, mixing, pii, secrets
from .durable import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Place of the tokenizer file; the package of public tokenizers is asked only here."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def spans_digest(found: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """doc_id, the number of base spans of each kind (column name by kind), base_sha256, spans and the number of these."""
    shown = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(n) for k, n in kinds.items()]
    return found.select("doc_id", *counts, F.sha2(F.expr(shown.format("base")).cast("binary"), 256).alias("base_sha256"), F.expr(shown.format("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op1_pii_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_digest(pii.scan(table(spark, sf_dir, "documents")), {k: f"n_{k}" for k in pii.KINDS})


def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sizes are checkpointed without texts, so that texts are read and cut into words once.
    slim = mixing.sized(table(spark, sf_dir, "documents")).select(F.struct("row.doc_id").alias("row"), "source", "size", "key")
    return mixing.mix(durable(slim)).select("row.doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.fit(documents))


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_lm_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), good)
    # Six decimals, so that the order of a sum does not show.
    return scored.withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss", "score", "corpus_loss")})


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.integers(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op9_secret_scan_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_digest(secrets.scan(table(spark, sf_dir, "documents")), {k: f"n_{k}" for k in secrets.KINDS})


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = flac.store(table(spark, sf_dir, "documents"))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -16, 16)).alias("tail_crc32"),
        F.length("flac").cast("long").alias("media_bytes"),
        F.sha2("flac", 256).alias("media_sha256"),
        "feature",
    )


def license_known_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of the second query over texts that are licences in other spellings, so that its join is tested."""
    return licenses.scan(licenses.made_texts(table(spark, sf_dir, "customer"))).select("doc_id", "license")


def flac_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of the tenth operator: the payload as it is read back, and its blocks."""
    stored = durable(flac.store(table(spark, sf_dir, "documents")))
    blocks = flac.pcm_blocks(stored).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("pcm")).cast("long").alias("block_bytes"))
    read = stored.select("doc_id", "n_bytes", F.length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"))
    return read.join(blocks, "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_skip_chain_crf": op1_pii_skip_chain_crf,
    "op2_license_digests": op2_license_digests,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_language_id": op5_language_id,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
    "op7_lm_cross_entropy": op7_lm_cross_entropy,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_secret_scan_cnn": op9_secret_scan_cnn,
    "op10_flac_media": op10_flac_media,
    "license_known_hits": license_known_hits,
    "flac_payloads": flac_payloads,
}

ORACLES: dict[str, str] = {
    "op2_license_digests": licenses.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op7_lm_cross_entropy": lm_scoring.ORACLE,
    "op8_exact_top_k": maxscore.ORACLE,
    "license_known_hits": licenses.MADE_ORACLE,
    "flac_payloads": flac.ORACLE,
}
