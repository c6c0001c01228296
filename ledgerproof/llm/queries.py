"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bytepairs, decontaminate, embeddings, langid, lexical, lm, quotes, records, sentencepieces, simhash, spellings, toxicity, warc
from .common import scratch, table

#: Public vocabulary files; a task opens them by name, wherever its own installation keeps them.
PIECES, WORDS, RANKS = "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def op1_template_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_records(spark, sf_dir):
    return records.roundtrip(table(spark, sf_dir, "documents"), WORDS, scratch(spark, "records"), end_id=2)


def op3_sentencepiece_agenda(spark, sf_dir):
    return sentencepieces.encode_documents(table(spark, sf_dir, "documents"), PIECES)


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("h")


def op5_log_bilinear_scores(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_quotation_threads(spark, sf_dir):
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op8_warc_revisits(spark, sf_dir):
    return warc.roundtrip(table(spark, sf_dir, "pages"), scratch(spark, "warc")).drop("target_uri")


def op9_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_rank_queue_bpe(spark, sf_dir):
    from public_tokenizers import PATTERN

    return bytepairs.encode_documents(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op12_spelling_variants(spark, sf_dir):
    return spellings.variants(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_template_decontamination, op2_token_records, op3_sentencepiece_agenda, op4_simhash_near_dedup, op5_log_bilinear_scores,
        op6_language_id, op7_quotation_threads, op8_warc_revisits, op9_embedding_near_dedup, op10_toxicity, op11_rank_queue_bpe,
        op12_spelling_variants, op13_lexical_search,
    )
}

#: Payloads below 100 bytes never revisit; the least page_id of equal payloads is the response.
ORACLE_SQL = {
    "op7_quotation_threads": quotes.SQL,
    "op13_lexical_search": lexical.SQL,
    "op8_warc_revisits": """
WITH heads AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), first AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS least FROM heads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN least < page_id THEN least END AS refers_to
FROM first""",
}
