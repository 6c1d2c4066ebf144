"""Named queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from foliospark.llm import ann, decontaminate, dialogue_repair, line_dedup, mixing, page_text, quality, secrets, simhash_dedup, suffix_dedup, url_filter, warc, whitening

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_secrets": secrets.op2_secrets,
    "op3_pages": page_text.op3_pages,
    "op4_neighbours": ann.op4_neighbours,
    "op5_mixing": mixing.op5_mixing,
    "op6_simhash": simhash_dedup.op6_simhash,
    "op7_suffix": suffix_dedup.op7_suffix,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_lines": line_dedup.op9_lines,
    "op10_urls": url_filter.op10_urls,
    "op11_warc": warc.op11_warc,
    "op12_whitening": whitening.op12_whitening,
    "op13_dialogue": dialogue_repair.op13_dialogue,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op11_warc": """
        WITH sized AS (
            SELECT page_id, url, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages
        ), placed AS (
            SELECT *, row_number() OVER same AS place, first_value(page_id) OVER same AS top
            FROM sized WINDOW same AS (PARTITION BY body ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST)
        )
        SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
            CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND place > 1 THEN top END AS refers_to,
            url, TRUE AS intact
        FROM placed""",
}
