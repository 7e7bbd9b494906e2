"""The registered queries of the text operators, and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.llm import blocknames, bpe, checks, collocations, decontaminate, kneser_ney, langid, ledger, merkle, pii, simhash, suffixes, urls, wrappers
from stallbook.llm.base import given


#: The rank file of the queries; its place is a parameter.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Items of `benchmark` contained in `documents`: 80 % of the five-word shingles or more."""
    found = decontaminate.contained_items(given(spark, folder, "documents"), given(spark, folder, "benchmark"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    got = wrappers.extract_main_text(given(spark, folder, "pages"))
    return got.withColumn("n_chars", F.length("text").cast("long"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the strings of 200 bytes that also start elsewhere."""
    got = suffixes.remove_repeats(given(spark, folder, "documents"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements and verdicts of every document under the current policy."""
    rows = ledger.ledger(given(spark, folder, "documents"))
    rows = ledger.apply_policy(ledger.apply_policy(rows, ledger.BASE, name="base_kept"), ledger.CURRENT)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~F.col("base_kept")).alias("base_failed"), "kept", "failed")


def quality_rule_ablations(spark: SparkSession, folder: str) -> DataFrame:
    """What each rule of the current policy decides alone, and what would be kept without it."""
    return ledger.ablations(ledger.ledger(given(spark, folder, "documents")), ledger.CURRENT)


def _listed(spans, kinds: list[str]):
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"].isin(kinds)), text), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and places of personal data in every document."""
    found = pii.find_spans(given(spark, folder, "documents").select("doc_id", "text"))
    base = [k.name for k in pii.KINDS if k.base]
    spans = F.col("pii_spans")
    counts = [F.size(F.filter(spans, _of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(_listed(spans, base), 256).alias("base_sha256"),
                        _listed(spans, [k.name for k in pii.KINDS]).alias("spans"))


def op6_byte_bpe(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Ids of every document under a public byte-level vocabulary, and the bytes they decode to."""
    got = bpe.encode(given(spark, folder, "documents"), vocabulary, public_tokenizers.PATTERN, decode=True)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity of every document and whether it is kept."""
    return kneser_ney.classify(given(spark, folder, "documents"), given(spark, folder, "labels")).drop("key")


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; a third of them is held out of training."""
    docs = given(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page."""
    judged = urls.judge_pages(given(spark, folder, "pages"), urls.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates of `documents` by SimHash: three-word shingles, links at three bits or fewer."""
    found = simhash.near_duplicates(given(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Proof of every document in the manifest, and whether its text, lower-cased in a third of them, still proves."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.when(third, F.translate("text", letters, letters.lower())).otherwise(F.col("text"))
    return merkle.manifest(given(spark, folder, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": lowered})


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Exact duplicates among all documents, blanks aside."""
    return blocknames.exact_duplicates(given(spark, folder, "documents"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The most tightly bound phrases of each language."""
    return collocations.collocations(given(spark, folder, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_language": op8_language,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_collocations": op13_collocations,
    "quality_rule_ablations": quality_rule_ablations,
}
#: What SQL cannot express (2, 3, 6, 7, 8, 10) is held against plain versions in tests/llm.
CHECKS = {
    "op1_decontamination": checks.DECONTAMINATION,
    "op4_quality_rules": checks.QUALITY_RULES,
    "op5_pii": checks.PII,
    "op9_url_filter": checks.URL_FILTER,
    "op11_merkle_manifest": checks.MERKLE_MANIFEST,
    "op12_exact_dedup": checks.EXACT_DEDUP,
    "op13_collocations": checks.PHRASES,
    "quality_rule_ablations": checks.RULE_ABLATIONS,
}
