"""Queries of the subpackage and their SQL, for the entry module."""

from __future__ import annotations

from glasra.llm import bpe, budget, garbled, language, leak, lookalike, mixing, pairs, pieces, sample
from glasra.tables import read, spread


def p7_found(spark, sf_dir: str):
    return lookalike.odd_texts(spread(read(spark, sf_dir, "asr_pairs").select("row_id", "ref", "hyp")))


def p7_forms(spark, sf_dir: str):
    return lookalike.forms(spread(read(spark, sf_dir, "asr_pairs").select("row_id", "ref", "hyp")))


def p7_groups(spark, sf_dir: str):
    return lookalike.skeleton_groups(read(spark, sf_dir, "asr_pairs"))


def p8_ids(spark, sf_dir: str):
    return bpe.token_ids(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    f.__name__: f
    for f in (
        sample.p1_sample,
        sample.p1_by_batch,
        budget.p2_documents,
        budget.p2_cube,
        budget.p2_against_report,
        pairs.p3_found,
        pairs.p3_by_model,
        language.p4_found,
        language.p4_languages,
        language.p4_stretches,
        mixing.p5_mix,
        mixing.p5_shares,
        mixing.p5_quotas,
        pieces.p6_found,
        pieces.p6_pieces,
        pieces.p6_piece_report,
        p7_found,
        p7_forms,
        p7_groups,
        p8_ids,
        leak.p9_found,
        leak.p9_alike,
        leak.p9_spans,
        garbled.p10_found,
        garbled.p10_restored,
    )
}

SQL = {
    **sample.SQL,
    **mixing.SQL,
    "p6_found": """
WITH c AS (SELECT DISTINCT key, units FROM cluas_units WHERE units IS NOT NULL AND len(units) > 0),
u AS (SELECT key, units, unnest(units) AS unit, generate_subscripts(units, 1) - 1 AS pos FROM c),
b AS (SELECT u.key, u.units, u.pos FROM u JOIN unit_inventory i ON u.unit = i.unit WHERE i.kind IN ('pause', 'breath')
  UNION ALL SELECT key, units, -1 FROM c UNION ALL SELECT key, units, len(units) FROM c),
g AS (SELECT key, pos, lead(pos) OVER (PARTITION BY key, units ORDER BY pos) AS nxt FROM b)
SELECT DISTINCT key, (pos + 1)::INT AS start_pos FROM g WHERE nxt - pos - 1 > 1024""",
}
