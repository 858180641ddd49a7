"""The queries of this subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, compression_quality, cover_dedup, fill_middle, html_extract, imatch, media_chunks, mixing, quotations, secret_scan, seed_extend, setsketch, token_alignment
from .common import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_extract.train(html_extract.labelled_pages(spark))
    return html_extract.extract(table(spark, sf_dir, "pages"), model)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_features(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary)


def op5_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.reply_ordered(table(spark, sf_dir, "conversations"))


def quoting(messages: DataFrame) -> DataFrame:
    """messages with quotations in three of four later turns, chosen by conversation and turn: of the turn
    before, of that with a nested quotation of the one before it, or of the conversation's first turn."""
    quoted = lambda c, sign: F.regexp_replace(c, r"(?m)^", sign)
    each = messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("said"))
    one, two = (each.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("said").alias(f"back{n}")) for n in (1, 2))
    first = each.where("turn = 0").select("conv_id", F.col("said").alias("opening"))
    joined = messages.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left").join(first, "conv_id", "left")
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    text = F.coalesce("text", F.lit(""))
    on = F.lit("Someone wrote:\n")
    made = (
        F.when((kind == 0) & F.col("back1").isNotNull(), F.concat(on, quoted(F.col("back1"), "> "), F.lit("\n"), text))
        .when((kind == 1) & F.col("back2").isNotNull(), F.concat(on, quoted(F.col("back1"), "> "), F.lit("\n"), quoted(F.col("back2"), ">> "), F.lit("\n"), text))
        .when((kind == 2) & (F.col("turn") > 0) & F.col("opening").isNotNull(), F.concat(quoted(F.col("opening"), "> "), F.lit("\n"), text))
        .otherwise(text)
    )
    return joined.select("conv_id", "turn", "role", made.alias("text"))


def quotations_in_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's operator over the conversations with quotations put in, as the tables hold hardly any."""
    return quotations.reply_ordered(quoting(table(spark, sf_dir, "conversations")))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edits(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seed_extend.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.digests(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return token_alignment.align(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source
), step AS (  -- a round holds at its ceiling every source whose share is above it
  SELECT 0 AS k, source, source_size, weight, false AS held FROM per
  UNION ALL
  SELECT k + 1, source, source_size, weight,
         held OR weight * (1.5 * sum(source_size) OVER () - sum(CASE WHEN held THEN 2 * source_size ELSE 0 END) OVER ())::DOUBLE
                 / nullif(sum(CASE WHEN held THEN 0 ELSE weight END) OVER (), 0) > 2 * source_size
  FROM step WHERE k < (SELECT count(*) FROM per)
), last AS (
  SELECT * FROM step WHERE k = (SELECT max(k) FROM step)
), targets AS (
  SELECT source, source_size,
         CASE WHEN held THEN (2 * source_size)::DOUBLE
              ELSE (1.5 * sum(source_size) OVER () - sum(CASE WHEN held THEN 2 * source_size ELSE 0 END) OVER ())::DOUBLE * weight
                   / sum(CASE WHEN held THEN 0 ELSE weight END) OVER () END AS target
  FROM last
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN (('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0) < rate - floor(rate)
                                   THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""


def queries() -> dict:
    found = (
        op1_html, op2_media, op3_secrets, op4_bpe, op5_quotations, op6_imatch, op7_near_duplicates, op8_quality,
        op9_substrings, op10_mixing, op11_suffix_dedup, op12_alignment, op13_fill_middle, quotations_in_replies,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_secrets": secret_scan.scan_sql(), "op10_mixing": OP10_SQL, "op13_fill_middle": fill_middle.SQL}
