"""One query for each corpus operator, at production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm import chat, decontaminate, embeddings, language_model, line_dedup, merkle, mixing, oracle, quality, runs, simhash, tokens, toxicity, warc
from strandspark.llm.common import fold, one_label, table
from strandspark.session import materialise

QUALITY_KEEPS = 0.3


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = one_label(table(spark, sf_dir, "labels"), "toxic")
    scored = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), labels, lambda i: fold(i) != 0)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = one_label(table(spark, sf_dir, "labels"), "quality")
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), labels, lambda i: fold(i) != 0)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_KEEPS).cast("int").alias("predicted"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "lines_removed", "text")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = fold(F.col("doc_id"))
    tune = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5) % 8 == 0
    return language_model.score(table(spark, sf_dir, "documents"), rest != 1, rest == 1, tune)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with a tail of words from the a-th on, repeated with period p, in those whose id's CRC is divisible by 10."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(w):
        n = F.size(w)
        a = F.floor(h / 10) % n
        p = 1 + F.floor((n - a) / (3 + F.floor(h / 10) % 8))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i.cast("long")).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: w[i.cast("int")]), " ")

    tail = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return docs.withColumn("text", F.when(h % 10 == 0, tail).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*LEAF_COLUMNS)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in LEAF_COLUMNS]
    docs = docs.withColumn("tampered", F.when(even, merkle.leaf_hash(other)))
    found = merkle.manifest(docs, LEAF_COLUMNS, carry=["tampered"])
    folded = found.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: A conversation of control strings, which comes with the table's own.
CONTROLLED = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = given.unionByName(spark.createDataFrame(CONTROLLED, given.schema))
    out = materialise(chat.format_chains(rows), "chat-formatted")
    turns = chat.read_back(F.col("formatted"))
    # text in a column of its own: hashed and measured, it is put together once
    read = out.select(F.col("tree").alias("conv_id"), turns.alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("trained"), F.length("formatted").cast("long").alias("formatted_chars"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mix_sources": mixing.equal_mix_sql(),
        "op8_warc": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages WHERE page_id IS NOT NULL),
            o AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS owner FROM p)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN owner <> page_id THEN owner END AS refers_to FROM o""",
        "op12_merkle_manifest": oracle.merkle_sql(),
        "op13_chat_formatting": oracle.chat_sql(),
    }
