"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tidewire.llm import clustering, embedding_dedup, language_id, line_dedup, linear_grouping, lm_scoring, mixing, ngram_join, packing, quality_rules, ranked_search, sharding, suffix_dedup
from tidewire.llm.common import documents

QUERIES = {
    "op1_embedding_near_dedup": lambda spark, d: embedding_dedup.digest(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op2_line_dedup": lambda spark, d: line_dedup.deduped(documents(spark, d)),
    "op3_packing": lambda spark, d: packing.digest(documents(spark, d)),
    "op4_suffix_array_dedup": lambda spark, d: suffix_dedup.digest(documents(spark, d)),
    "op5_mixing": lambda spark, d: mixing.digest(documents(spark, d)),
    "op6_language_id": lambda spark, d: language_id.digest(documents(spark, d)),
    "op7_sharding": lambda spark, d: sharding.digest(documents(spark, d)),
    "op8_lm_scoring": lambda spark, d: lm_scoring.digest(documents(spark, d)),
    "op9_ngram_jaccard_join": lambda spark, d: ngram_join.digest(documents(spark, d)),
    "pipeline": corpus_pipeline.run,
    "op10_quality_rules": lambda spark, d: quality_rules.digest(documents(spark, d)),
    "op11_ranked_lexical_search": lambda spark, d: ranked_search.digest(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    "op12_best_fit_packing": lambda spark, d: linear_grouping.digest(documents(spark, d)),
    "op13_centroid_clustering": lambda spark, d: clustering.digest(spark.read.parquet(f"{d}/embeddings.parquet")),
}
SQL = {"op2_line_dedup": line_dedup.SQL, "op10_quality_rules": quality_rules.SQL, "op11_ranked_lexical_search": ranked_search.SQL, "op13_centroid_clustering": clustering.SQL}
