"""The subpackage's queries ``(spark, sf_dir) -> DataFrame`` by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillhouse.llm import bpe, collocations, grid_join, licenses, lines, ngram_join, packing, quality, rank_array, resampling, suffix, toxicity, warc


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(read(spark, sf_dir, "pages"))).withColumnRenamed("source_id", "page_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _tokenizer("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(read(spark, sf_dir, "documents"), ranks, _pattern())
    back = bpe.decode(ids, ranks)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.line_first(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_dropped", "chars_dropped")])


def op8_embedding_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_vectors(read(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizer("byte_bpe_50k.json")
    back = rank_array.decode(rank_array.encode(read(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return resampling.resample(docs, resampling.fit(docs, read(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_embedding_grid_join": op8_embedding_grid_join,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_collocations": op11_collocations,
    "op12_rank_array_bpe": op12_rank_array_bpe,
    "op13_importance_resampling": op13_importance_resampling,
}

_LINES = """
  l as (select doc_id, i, x, case when length(k) >= 10 then k end as k from (
    select doc_id, i, x, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from (
      select doc_id, unnest(range(1, len(a) + 1)) as i, unnest(a) as x from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents where doc_id is not null)))),
  f as (select k, min(doc_id) as first_doc from l where k is not null group by k having count(distinct doc_id) >= 2)
"""

ORACLES: dict[str, str] = {
    "op1_warc_derivatives": warc.oracle(),
    "op6_line_dedup": f"""
with {_LINES}
select l.doc_id, count(*) as n_lines, count(*) filter (where f.first_doc < l.doc_id) as n_dropped,
  sha256(coalesce(string_agg(x, chr(10) order by i) filter (where f.first_doc is null or f.first_doc >= l.doc_id), '')) as kept_sha256
from l left join f using (k) group by l.doc_id
""",
    "op11_collocations": collocations.oracle(),
}
