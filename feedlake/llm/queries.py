"""Registered queries of the corpus operators, ``(spark, sf_dir) -> DataFrame``, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.llm import language, mixing, packing, periodic, toxicity
from feedlake.llm.anchors import without_passages
from feedlake.llm.common import scanned, table
from feedlake.llm.exact_dedup import OP3_SQL, exact_dedup
from feedlake.llm.ngram_join import ngram_join
from feedlake.llm.repeats import without_repeats
from feedlake.llm.search import OP12_SQL, search
from feedlake.llm.secrets import secrets
from feedlake.llm.sharding import shard
from feedlake.llm.topk import OP1_SQL, top_k


def op1_topk(spark, d):
    return top_k(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_suffix_dedup(spark, d):
    return without_repeats(table(spark, d, "documents"))


def op3_exact_dedup(spark, d):
    return exact_dedup(table(spark, d, "documents")).drop("row")


def op4_toxicity(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, d, "labels")))


def op5_mixing(spark, d):
    return mixing.schedule(scanned(table(spark, d, "documents"))).drop("row")


def op6_packing(spark, d):
    return packing.pack(table(spark, d, "documents"))


def op7_ngram_join(spark, d):
    return ngram_join(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op8_language(spark, d):
    docs = table(spark, d, "documents")
    return language.language(docs, language.train(docs))


def op9_sharding(spark, d):
    return shard(table(spark, d, "documents"))


def op10_secrets(spark, d):
    return secrets(table(spark, d, "documents"))


def op11_passages(spark, d):
    return without_passages(table(spark, d, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_search(spark, d):
    return search(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op13_periodic(spark, d):
    docs = table(spark, d, "documents")
    return periodic.digests(periodic.periodic_runs(docs.select("doc_id", periodic.looped(F.col("doc_id"), F.col("text")).alias("text"))))


QUERIES = {f.__name__: f for f in (op1_topk, op2_suffix_dedup, op3_exact_dedup, op4_toxicity, op5_mixing, op6_packing, op7_ngram_join,
                                   op8_language, op9_sharding, op10_secrets, op11_passages, op12_search, op13_periodic)}
ORACLE = {"op1_topk": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op12_search": OP12_SQL}
