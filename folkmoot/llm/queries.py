"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folkmoot.llm import ann_forest, chat_format, exact_dedup, html_main_text, lang_id, lexical_rank, mixing, ngram_join, piece_sampling, quality_rank, simhash_near, token_store, whitening
from folkmoot.llm._common import scratch, table

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(WORD_TOKENIZER), end_id=2)
    return token_store.read_tokens(spark, path)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    path = scratch(spark, "chats")
    chat_format.render(chat_format.fold_events(chat_format.turns_as_events(turns.unionByName(added)))).write.parquet(path)
    return chat_format.digests(chat_format.parse(spark.read.parquet(path)))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(replace(role, '\', '\\'), '(<|\[)(/?(?:s>|INST\]|<SYS>>|/?SYS>>|\|))', '\1\\\2', 'g')) AS r,
         length(regexp_replace(replace(text, '\', '\\'), '(<|\[)(/?(?:s>|INST\]|<SYS>>|/?SYS>>|\|))', '\1\\\2', 'g')) AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(10 + r + 9 + n + 5) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


OP4_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main_text.extract_pages(table(spark, sf_dir, "pages"))


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def op8_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = quality_rank.fit(docs, table(spark, sf_dir, "labels"), ~held_out, at_cut=0.3)
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_rank.quality(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = lang_id.fit(docs.filter(~held_out))
    told = docs.select("doc_id", held_out.alias("held_out"), lang_id.identify(F.col("text"), model).alias("told"))
    return told.select("doc_id", "held_out", "told.lang_pred", "told.score", "told.rejected")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near.simhash_near(table(spark, sf_dir, "documents"))


def op13_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
 s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
 t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), s),
 e AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // l)))) AS BIGINT) AS score FROM t JOIN v USING (term) JOIN q USING (term), s GROUP BY 1, 2, 3)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM e WHERE score > 0 QUALIFY rank <= 20
"""


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_chat_format": op2_chat_format,
    "op3_ngram_join": op3_ngram_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_piece_sampling": op6_piece_sampling,
    "op7_html_main_text": op7_html_main_text,
    "op8_quality_rank": op8_quality_rank,
    "op9_lang_id": op9_lang_id,
    "op10_nearest": op10_nearest,
    "op11_whitening": op11_whitening,
    "op12_simhash_near": op12_simhash_near,
    "op13_lexical_rank": op13_lexical_rank,
}
ORACLE_SQL = {"op2_chat_format": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op13_lexical_rank": OP13_SQL}
