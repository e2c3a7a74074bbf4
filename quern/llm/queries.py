"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from quern.llm import bpe, chat, decontaminate, langid, licenses, perplexity, quality, simhash, urls, warc

QUERIES = {
    "op1_ngram_perplexity": perplexity.op1_ngram_perplexity,
    "op2_url_filter": urls.op2_url_filter,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_language_id": langid.op4_language_id,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_chat_format": chat.op8_chat_format,
    "op9_capture_index": warc.op9_capture_index,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
}
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": urls.SQL,
    "op4_language_id": langid.SQL,
    "op9_capture_index": warc.SQL,
}
