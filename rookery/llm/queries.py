"""The operators over the tables they are meant for, and their SQL where there is some."""

from __future__ import annotations

from . import decontaminate, language, mixing, neardup, neighbours, perplexity, sharding, substrings, urls, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_warc": warc.op3_warc,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_substrings": substrings.op5_substrings,
    "op6_mixing": mixing.op6_mixing,
    "op7_url_filters": urls.op7_url_filters,
    "op8_language": language.op8_language,
    "op9_perplexity": perplexity.op9_perplexity,
    "op10_neighbours": neighbours.op10_neighbours,
}

ORACLE_SQL: dict[str, str] = {"op1_sharding": sharding.SQL, "op8_language": language.SQL, "op3_warc": warc.SQL, "op5_substrings": substrings.SQL, "op7_url_filters": urls.SQL, "op10_neighbours": neighbours.SQL}
