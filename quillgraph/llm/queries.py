"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from ..session import table
from . import gif, langid, licenses, mixing, neardup, packing, pii, quality, suffixdup, tokens

MIXTURE = mixing.Mixture(weights={"src0": 3.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}, default_weight=1.0, share=0.7, length="tokens")
PASSAGES = suffixdup.Settings(min_words=50, gram=25)
PACKING = packing.Packing(buckets=16, token_budget=65_536, length="tokens")


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), PACKING)


def op3_licenses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licenses.find(docs, licenses.train(docs))


def op4_minhash_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark, sf_dir):
    return suffixdup.repeated_passages(table(spark, sf_dir, "documents"), PASSAGES)


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), MIXTURE)


def op7_gif_media(spark, sf_dir):
    return gif.frames(gif.page_media(table(spark, sf_dir, "pages")))


def op8_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.compression_quality(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    return tokens.section_tokens(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline  # it imports this module's parameters

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_licenses": op3_licenses,
    "op4_minhash_neardup": op4_minhash_neardup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mixing": op6_mixing,
    "op7_gif_media": op7_gif_media,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
    "pipeline": pipeline,
}
#: Tokens can't be counted in SQL: the SQL of packing and mixing is tested against their estimated lengths.
ORACLE = {"op5_suffix_dedup": suffixdup.passages_sql(PASSAGES)}
