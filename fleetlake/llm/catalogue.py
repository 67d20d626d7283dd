"""The registered queries of this package, over whole tables, and the stages
of the corpus pipeline."""

from __future__ import annotations

import itertools
from typing import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (classifier, context_tree, decontaminate, license_scan, line_dedup, near_dedup, packing,
               periodic_runs, pivot_index, quality_rules, token_alignment, token_counts, url_filter)

#: Labels are learned from ids outside this fold.
QUALITY_FOLDS, QUALITY_FOLD = 3, 1
WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
#: Every such vec_id is a query.
SEARCH_EVERY = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _fold(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % QUALITY_FOLDS == QUALITY_FOLD, F.lit(False))


def _quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    return classifier.fit(docs, _table(spark, sf_dir, "labels"), learn_from=~_fold(F.col("i")))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document for quality, learned outside one fold."""
    docs = _texts(spark, sf_dir)
    scored = classifier.score(docs, _quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", _fold(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(_texts(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER), with_ids=False)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.digest(decontaminate.find(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the line-first verdict on every document."""
    out = quality_rules.clean(_texts(spark, sf_dir), with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_failed", "chars_lost")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed licenses of every document."""
    out = license_scan.scan(_texts(spark, sf_dir))
    return out.select("doc_id", "n_blocks", F.size("found").cast("long").alias("n_found"),
                      F.concat_ws(",", F.array_sort(F.array_distinct("found.license"))).alias("licenses"),
                      F.round(F.array_max("found.reduction"), 4).alias("best_reduction"),
                      F.concat_ws("|", "found.differences").alias("differences"))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the trained context tree."""
    return context_tree.score(_texts(spark, sf_dir)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_length")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_dedup.near_duplicates(_texts(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after a light cleaning."""
    return token_counts.count_edited(_texts(spark, sf_dir), public_tokenizers.path(BYTE_TOKENIZER),
                                     public_tokenizers.PATTERN, with_text=False) \
        .select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that a smaller one has."""
    return line_dedup.digest(line_dedup.dedup(_texts(spark, sf_dir)))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizations of every document."""
    return token_alignment.digest(_texts(spark, sf_dir), public_tokenizers.path(BYTE_TOKENIZER),
                                  public_tokenizers.path(PIECE_TOKENIZER))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document."""
    return periodic_runs.runs(_texts(spark, sf_dir), with_text=False, order=periodic_runs.planted_order)


def op13_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth."""
    return pivot_index.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % SEARCH_EVERY == 0)


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``documents``, with ``n_chars`` of the text as it is."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names called something that no column
    is called, and the names to give them back."""
    taken, back = {c.lower() for c in docs.columns}, {}
    for c in [c for c in docs.columns if c.lower() in names]:
        free = next(f"{c}_{k}" for k in itertools.count() if f"{c}_{k}".lower() not in taken)
        taken.add(free.lower())
        back[free] = c
    return docs.withColumnsRenamed({c: free for free, c in back.items()}), back


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject."""
    named, back = _aside(docs, "score")
    kept = classifier.score(named, _quality_model(spark, docs, sf_dir)).where("score >= 0.5")
    return kept.select(*[F.col(f"`{c}`") for c in named.columns]).withColumnsRenamed(back)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document has go; so do documents that lose all
    their text."""
    named, back = _aside(docs, "n_lines", "n_dropped")
    out = line_dedup.dedup(named).where(~((F.col("n_dropped") > 0) & (F.btrim("text", F.lit(" \t\n\x0b\f\r")) == "")))
    out = out.select(*[F.col(f"`{c}`") for c in named.columns]).withColumnsRenamed(back)
    return _with_length(out, docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return near_dedup.drop_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly that go."""
    return _with_length(decontaminate.remove(docs, _table(spark, sf_dir, "benchmark")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences, piece by piece, with their token ids."""
    return packing.pack(docs, public_tokenizers.path(WORD_TOKENIZER))


STAGES = [("quality_classifier", keep_quality), ("line_dedup", drop_lines), ("near_dedup", drop_copies),
          ("decontaminate", drop_benchmark), ("packing", pack)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fns = [op1_quality_classifier, op2_url_filter, op3_packing, op4_decontaminate, op5_quality_rules,
           op6_license_scan, op7_context_tree, op8_near_dedup, op9_token_counts, op10_line_dedup,
           op11_token_alignment, op12_periodic_runs, op13_pivot_index]
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the whole result."""
    return {"op4_decontaminate": decontaminate.SQL.strip(), "op5_quality_rules": quality_rules.SQL.strip(),
            "op8_near_dedup": near_dedup.SQL.strip(), "op10_line_dedup": line_dedup.SQL.strip()}
