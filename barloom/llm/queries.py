"""Queries op1 to op13: thin steps from the given tables to the operators and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import benchmark as bench
from barloom.llm.jaccard import near_duplicates
from barloom.llm.licenses import scan_licenses
from barloom.llm.lexical import index_notes, rank_notes
from barloom.llm.line_dedup import dedup_lines
from barloom.llm.nearest import similar_tickers
from barloom.llm.packing import Limits, pack_notes
from barloom.llm.personal import find_personal
from barloom.llm.quality import fit_quality, judge_notes
from barloom.llm.sharding import balanced_shards
from barloom.llm.suffixes import cut_repeats
from barloom.llm.wavelet import read_token_shards, write_token_shards
from barloom.llm.whitening import whiten_features
from barloom.session import scratch_path


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as notes of positions: every row, the whole text."""
    return as_notes(spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet"))


def as_notes(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({"doc_id": "position_id", "text": "note"})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("note", F.lit(""))
    rows = notes(spark, folder).select("position_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                                       F.crc32(text.cast("binary")).alias("text_crc32"), F.md5("note").alias("note_hash"))
    return balanced_shards(rows, 40, hubs=("note_hash",)).select(
        F.col("position_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_patience_lines(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(notes(spark, folder)).select(
        F.col("position_id").alias("doc_id"), "n_lines", "n_removed", F.sha2("note", 256).alias("kept_sha256"))


def op4_likelihood_ratio(spark: SparkSession, folder: str) -> DataFrame:
    model = fit_quality(notes(spark, folder), reviews(spark, folder))
    rows = notes(spark, folder).select("position_id", "note")
    return judge_notes(rows, model).select(
        F.col("position_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").withColumnRenamed("doc_id", "position_id")


def op5_suffix_family(spark: SparkSession, folder: str) -> DataFrame:
    return cut_repeats(notes(spark, folder).select("position_id", "note")).select(
        F.col("position_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_signature_tree(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(notes(spark, folder), words=4, percent=85).select(
        F.col("position_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op7_license_join(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(notes(spark, folder).select("position_id", "note")).withColumnRenamed("position_id", "doc_id")


def op8_weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal(notes(spark, folder).select("position_id", "note"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(F.col("position_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
                        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op10_block_max_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return bench.find_leaks(notes(spark, folder), table(spark, folder, "benchmark")).withColumnRenamed("position_id", "doc_id")


def op3_wavelet_matrix(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "wavelet")
    write_token_shards(notes(spark, folder), path, vocabulary())
    return read_token_shards(spark, path).select(
        F.col("position_id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(notes(spark, folder))


def packed(given: DataFrame) -> DataFrame:
    return pack_notes(given, vocabulary(), limits=Limits(tokens=2048, segments=256, loss=2048)).select(
        F.col("position_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        F.col("note_tokens").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")


def exposures(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as feature rows of tickers."""
    return table(spark, folder, "embeddings").withColumnsRenamed({"vec_id": "ticker", "embedding": "features"})


def op11_bit_sliced_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = similar_tickers(exposures(spark, folder), F.col("ticker") % 50 == 0, 5, scale=256)
    return found.withColumnsRenamed({"ticker": "query_id", "match": "vec_id"})


def op12_bit_sliced_scatter(spark: SparkSession, folder: str) -> DataFrame:
    return (whiten_features(exposures(spark, folder), 32, grid=64).withColumnRenamed("ticker", "vec_id")
            .withColumn("deviation", F.expr("try_cast(deviation as bigint)")))


def op13_hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    index = index_notes(notes(spark, folder).select("position_id", "note"))
    return rank_notes(index, table(spark, folder, "benchmark"), 10).withColumnRenamed("position_id", "doc_id")


QUERIES = {f.__name__: f for f in (
    op1_label_propagation, op2_patience_lines, op3_wavelet_matrix, op4_likelihood_ratio, op5_suffix_family, op6_signature_tree,
    op7_license_join, op8_weak_labels, op9_vector_packing, op10_block_max_bm25, op11_bit_sliced_topk, op12_bit_sliced_scatter,
    op13_hybrid_search)}

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op11_bit_sliced_topk": """
with v as (
  select row_number() over () as id, vec_id, list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (
  select q.id, q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.x, v.x) as bigint) as score
  from v as q join v on q.id <> v.id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op13_hybrid_search": f"""
with tf as (
  select doc_id, term, count(*) as tf from (select doc_id, unnest({_TERMS}) as term from documents) group by doc_id, term),
note as (select doc_id, cast(sum(tf) as bigint) as n from tf group by doc_id),
total as (select count(*) as notes, cast(sum(n) as bigint) as words from note),
held as (select term, cast(floor(1000 * ln((2.0::double * any_value(notes) + 2) / (2 * count(*) + 1))) as bigint) as w
         from tf, total group by term),
asked as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by item_id, term),
scored as (
  select item_id, doc_id,
         cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * notes) // words)))) as bigint) as score
  from asked join held using (term) join tf using (term) join note using (doc_id), total group by item_id, doc_id),
r as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from scored where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10""",
}
