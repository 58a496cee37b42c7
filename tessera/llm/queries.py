"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import counts, dialogue, lexical, middle, mixing, packing, quality, rans, sharding, simhash, substrings, vectors


#: Vocabulary files are read where the tokenizer package has them; another path is a parameter of the operators.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.drop("positions").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), capacity=2048)


def op5_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rans.scratch_path(spark)
    rans.write_tokens(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), path, end=0)
    return rans.read_tokens(spark, path).drop("ids")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), limit=2048)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % quality.FOLDS == 0
    scored = quality.scores(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


def op10_top_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_inner(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_retrieval_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), capacity=2048)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=1)
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restored(), 256).alias("restored_sha256")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return dialogue.audits(dialogue.damaged(rows), rows)


QUERIES = {
    "op1_mix": op1_mix,
    "op2_nearest": op2_nearest,
    "op3_substrings": op3_substrings,
    "op4_pack": op4_pack,
    "op5_rans": op5_rans,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_shard": op9_shard,
    "op10_top_inner": op10_top_inner,
    "op11_retrieval_pack": op11_retrieval_pack,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_dialogue_repair": op13_dialogue_repair,
}

#: Seeded orders, hashes, learned weights and library token ids are beyond SQL; an exact integer search is not.
ORACLE_SQL: dict[str, str] = {
    "op10_top_inner": """
        WITH x AS (SELECT vec_id, [floor(256 * CAST(c AS DOUBLE)) for c in embedding] AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
              FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
    "op12_fill_in_middle": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                          sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        d AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || h[8 * k + 1 : 8 * k + 8] AS BIGINT) for k in [0, 1, 2, 3]] AS h4 FROM t),
        c AS (SELECT *, least(h4[1] % (n + 1), h4[2] % (n + 1)) AS a, greatest(h4[1] % (n + 1), h4[2] % (n + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h4[3] % 100 >= 90 THEN 'plain'
                          WHEN h4[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
}
