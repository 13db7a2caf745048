"""The queries opN of the ten operators, each over its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontaminate, langid, licenses, mixing, quality_bayes, quality_rules, secrets, simhash, sql, tokens, toxicity
from strata.llm.common import free_name, table


def tokenizer_path() -> str:
    """The vocabulary file of the token ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), sql.TARGETS, otherwise=sql.OTHERWISE)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_paths(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    return found.select(F.col("path").alias("doc_id"), *map(count, secrets.BASE), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id"), 3, 1))
    model = langid.train(docs.filter("not held_out"))
    found = langid.identify(docs, model, into="language")
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    labels = table(spark, sf_dir, "labels").filter(~langid.held_out(F.col("doc_id"), 4, 2))
    model = toxicity.train(docs.filter("not held_out"), labels)
    found = toxicity.score_texts(docs, model, into="score")
    return found.select("doc_id", "held_out", "score").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), into="hits")
    ids = F.array_join(F.array_sort(F.transform("hits.items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "hits.n_words", "hits.n_hit", "hits.n_items", F.sha2(ids, 256).alias("items_sha256"), "hits.contaminated")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    places = [f"at_{i}" for i in range(len(licenses.BASE_PHRASES))]
    every = F.concat(*places)
    base = F.filter(F.array(*(F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(places, licenses.BASE_PHRASES, strict=True))), lambda x: x.isNotNull())
    labels = F.array_sort(F.array_union(base, F.transform("matches", lambda x: x["label"])))
    score = F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0)))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    name = free_name(docs, "quality")
    found = quality_rules.quality_rules(docs, into=name, keep_text=False)
    return found.select("doc_id", *(f"{name}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_secrets, op3_language_id, op4_toxicity, op5_decontamination, op6_quality_classifier, op7_tokens, op8_licenses, op9_simhash, op10_quality_rules)
}
SQL: dict[str, str] = sql.SQL
