"""The registered queries on the smallest tables, and the SQL of those that have it."""

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())


LONG, INT, TEXT, DOUBLE = "bigint", "int", "string", "double"
COLUMNS = {
    "op1_mix": {"doc_id": LONG, "size": LONG, "source_size": LONG, "target": DOUBLE, "taken": LONG},
    "op2_nearest": {"query_id": LONG, "rank": INT, "vec_id": LONG, "score": DOUBLE},
    "op3_substrings": {"doc_id": LONG, "n_words": LONG, "n_removed": LONG, "kept_sha256": TEXT},
    "op4_pack": {"doc_id": LONG, "piece": INT, "start": LONG, "length": LONG, "ids_crc32": LONG, "sequence_id": LONG, "offset": LONG},
    "op5_rans": {"doc_id": LONG, "start": LONG, "n_tokens": LONG, "ids_crc32": LONG},
    "op6_token_counts": {"doc_id": LONG, "n_bytes": LONG, "n_tokens": LONG, "over_limit": "boolean"},
    "op7_simhash": {"doc_id": LONG, "fingerprint": TEXT, "component_id": LONG},
    "op8_quality": {"doc_id": LONG, "held_out": "boolean", "score": DOUBLE, "predicted": INT},
    "op9_shard": {"doc_id": LONG, "size": LONG, "text_crc32": LONG, "law": TEXT, "shard": INT, "slot": LONG, "grown_shard": INT},
    "op10_top_inner": {"query_id": LONG, "rank": INT, "vec_id": LONG, "score": LONG},
    "op11_retrieval_pack": dict.fromkeys(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], LONG),
    "op12_fill_in_middle": {"doc_id": LONG, "n": LONG, "form": TEXT, "prefix_chars": LONG, "middle_chars": LONG, "output_sha256": TEXT, "restored_sha256": TEXT},
    "op13_dialogue_repair": {"conv_id": LONG, **dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], LONG), "audit": TEXT, "repaired_sha256": TEXT},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_results_have_their_columns(spark, name):
    got = dict(queries.QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
    assert {c: got.get(c) for c in COLUMNS[name]} == COLUMNS[name]


def test_token_counts_equal_the_library(spark):
    """op6 and op5 against the library itself, on whole texts."""
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    full = Tokenizer.from_file(queries.vocabulary(queries.WORD_BPE))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.op6_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (len((t or "").encode()), len(full.encode(t or "", add_special_tokens=False).ids)) for d, t in texts.items()}
