"""The subpackage's queries and their SQL."""

from __future__ import annotations

from strandtally.llm import backoff_lm, collocations, decontam, language_id, line_dedup, line_frequency, packing, secret_scan, simhash, token_align, token_files, url_filter, warc

QUERIES = {
    "op1_warc_chunks": warc.op1_warc_chunks,
    "op2_simhash": simhash.op2_simhash,
    "op3_packing": packing.op3_packing,
    "op4_line_frequency": line_frequency.op4_line_frequency,
    "op5_url_globs": url_filter.op5_url_globs,
    "op6_token_files": token_files.op6_token_files,
    "op7_backoff_lm": backoff_lm.op7_backoff_lm,
    "op8_language_id": language_id.op8_language_id,
    "op9_winnowing": decontam.op9_winnowing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_token_align": token_align.op12_token_align,
    "op13_collocations": collocations.op13_collocations,
}
SQL = {
    "op1_warc_chunks": warc.SQL,
    "op4_line_frequency": line_frequency.SQL,
    "op5_url_globs": url_filter.SQL,
    "op9_winnowing": decontam.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op13_collocations": collocations.SQL,
}
