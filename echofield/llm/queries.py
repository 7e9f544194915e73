"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from . import decontaminate, language_id, line_dedup, media_ogg, ngram_join, packing, quality_rules, sharding, url_filter, warc_index

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_line_dedup": line_dedup.query,
    "op3_url_filter": url_filter.query,
    "op4_lpt_sharding": sharding.query,
    "op5_decontamination": decontaminate.query,
    "op6_ogg_media": media_ogg.query,
    "op7_ngram_join": ngram_join.query,
    "op8_vector_packing": packing.query,
    "op9_warc_index": warc_index.query,
    "op10_quality_rules": quality_rules.query,
}

ORACLE_SQL = {"op2_line_dedup": line_dedup.SQL, "op9_warc_index": warc_index.SQL}
