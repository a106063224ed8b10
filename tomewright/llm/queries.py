"""The registered queries over the corpus tables, with production parameters, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, extract, linededup, mixing, mtree, oracles, pieces, quality, simhash, spelling, tokens, urls, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark, sf_dir):
    rows = pieces.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_embedding_near_dedup(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "score", "keep")


def op9_nearest_neighbours(spark, sf_dir):
    return vectors.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


#: The mixture: sources whose number ends in 0 to 4 are the domain web, the others books.
LEVELS = {"domain": "case when right(source, 1) between '0' and '4' then 'web' else 'books' end", "lang": "lang", "source": "source"}
WEIGHTS = {"web": 3, "books": 2, "web/en": 4, "web/de": 2, "books/en": 3, "web/en/src0": 2}
FRACTION, EPOCHS, SEED = 0.9, 2, 7


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), LEVELS, WEIGHTS, FRACTION, seed=SEED, max_epochs=EPOCHS)


def op6_html_extraction(spark, sf_dir):
    return extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_filters(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op11_exact_top_k(spark, sf_dir):
    return mtree.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark, sf_dir):
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_token_counts, op3_embedding_near_dedup, op4_sentencepiece, op5_mixing, op6_html_extraction, op7_line_dedup, op8_quality_classifier,
        op9_nearest_neighbours, op10_url_filters, op11_exact_top_k, op12_spelling_variants, op13_filter_audit,
    )
}
#: The others have no SQL form: hashes, encodings, trained models, or approximate search.
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_near_dedup": oracles.near_vectors_sql(0.93),
    "op5_mixing": oracles.mix_sql(LEVELS, WEIGHTS, FRACTION, SEED, EPOCHS),
    "op7_line_dedup": oracles.lines_sql(),
    "op10_url_filters": oracles.urls_sql(urls.RULES),
    "op11_exact_top_k": oracles.top_products_sql(10),
    "op12_spelling_variants": oracles.spelling_sql(),
    "op13_filter_audit": oracles.audit_sql(),
}
