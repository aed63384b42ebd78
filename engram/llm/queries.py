"""Registered queries of the text-corpus operators, and the DuckDB SQL that checks them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from engram.llm import common as C
from engram.llm import (
    audit,
    decontaminate,
    exact,
    language,
    lines,
    minhash,
    packing,
    quality,
    ranking,
    secrets,
    substring,
    tokens,
    toxicity,
)
from engram.session import shared_folder



def vocabulary() -> str:
    """Path of the tokenizer file; installed beside the library, never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_blocks(spark, sf_dir):
    folder = os.path.join(shared_folder(spark), "engram-llm", f"tokens-{uuid.uuid4().hex}")
    tokens.write_blocks(C.table(spark, sf_dir, "documents"), vocabulary(), folder)
    return tokens.read_blocks(spark, folder)


def op3_content_sort(spark, sf_dir):
    return exact.content_groups(C.table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(C.table(spark, sf_dir, "documents"), vocabulary())


def op2_toxic_segments(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, C.table(spark, sf_dir, "labels"), C.crc_remainder(5) != 0)
    return toxicity.passages(docs, model).select(
        "doc_id", (C.crc_remainder(5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"))


def op4_spaced_seeds(spark, sf_dir):
    return decontaminate.overlaps(C.table(spark, sf_dir, "documents"),
                                  C.table(spark, sf_dir, "benchmark"))


def op5_neighbour_votes(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    model = quality.learn(docs, C.table(spark, sf_dir, "labels"), C.crc_remainder(3) != 1)
    return quality.scores(docs, model).select(
        "doc_id", (C.crc_remainder(3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_hyperminhash(spark, sf_dir):
    return minhash.near_groups(C.table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_induced_suffixes(spark, sf_dir):
    return substring.remove_repeats(C.table(spark, sf_dir, "documents"), 400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_windows(spark, sf_dir):
    return lines.drop_repeated_lines(C.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_byte_convolution(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    network = language.learn(docs, C.crc_remainder(4) != 2)
    return language.predict(docs, network).select(
        "doc_id", (C.crc_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op11_document_tree(spark, sf_dir):
    return ranking.search(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op12_secret_network(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn(docs))


def op13_gray_code_audit(spark, sf_dir):
    return audit.audit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_token_blocks, op2_toxic_segments, op3_content_sort, op4_spaced_seeds,
    op5_neighbour_votes, op6_best_fit_packing, op7_hyperminhash, op8_induced_suffixes,
    op9_line_windows, op10_byte_convolution,
    op11_document_tree, op12_secret_network, op13_gray_code_audit)}

ORACLES = {
    "op3_content_sort": r"""
        WITH clean AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
          FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM clean WINDOW g AS (PARTITION BY t)""",
    "op4_spaced_seeds": decontaminate.oracle_sql(),
    "op7_hyperminhash": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sh AS (
          SELECT doc_id, unnest(list_distinct(CASE
            WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' ')) END))
            AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
          FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (
          SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * k >= 85 * (x.n + y.n - k)),
        two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(doc_id, other) AS (
          SELECT doc_id, doc_id FROM documents
          UNION SELECT reach.doc_id, two.b FROM reach JOIN two ON two.a = reach.other),
        comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id,
               doc_id = component_id AS kept
        FROM comp LEFT JOIN n USING (doc_id)""",
    "op9_line_windows": lines.ORACLE_SQL,
    "op11_document_tree": ranking.ORACLE_SQL,
    "op13_gray_code_audit": audit.ORACLE_SQL,
}
