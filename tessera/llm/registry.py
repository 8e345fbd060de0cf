"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import chat, language, licenses, mixing, mtree, packing, pitman_yor, quality, secrets, shingle_join
from tessera.llm.common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_compression_bands(spark, sf_dir):
    found = quality.judge(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"
    )


def op2_mtree_topk(spark, sf_dir):
    return mtree.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_diagonal_licenses(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_poisson_mix(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).drop("shuffle_key")


def op5_bayes_language(spark, sf_dir):
    return language.identify(read(spark, sf_dir, "documents"))


def op6_tournament_packing(spark, sf_dir):
    return packing.digest(packing.pack(read(spark, sf_dir, "documents"), tokenizer_path()))


def op7_crf_secrets(spark, sf_dir):
    return secrets.digest(secrets.find(read(spark, sf_dir, "documents")))


def op8_pitman_yor_scores(spark, sf_dir):
    return pitman_yor.score(read(spark, sf_dir, "documents"))


def op9_divide_skip_join(spark, sf_dir):
    return shingle_join.join(read(spark, sf_dir, "documents"))


def op10_columnar_chat(spark, sf_dir):
    return chat.digests(chat.format_chats(chat.with_probe(read(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_compression_bands": op1_compression_bands,
    "op2_mtree_topk": op2_mtree_topk,
    "op3_diagonal_licenses": op3_diagonal_licenses,
    "op4_poisson_mix": op4_poisson_mix,
    "op5_bayes_language": op5_bayes_language,
    "op6_tournament_packing": op6_tournament_packing,
    "op7_crf_secrets": op7_crf_secrets,
    "op8_pitman_yor_scores": op8_pitman_yor_scores,
    "op9_divide_skip_join": op9_divide_skip_join,
    "op10_columnar_chat": op10_columnar_chat,
}
ORACLE_SQL = {
    "op2_mtree_topk": mtree.ORACLE,
    "op3_diagonal_licenses": licenses.oracle(),
    "op4_poisson_mix": mixing.oracle(),
    "op9_divide_skip_join": shingle_join.oracle(),
    "op10_columnar_chat": chat.ORACLE,
}
