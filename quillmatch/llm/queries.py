"""The queries of this subpackage and their SQL."""

from quillmatch.llm.decontaminate import op9_decontaminate
from quillmatch.llm.language_id import op8_language_id
from quillmatch.llm.line_dedup import OP4_SQL, op4_line_dedup
from quillmatch.llm.mixing import OP3_SQL, op3_mix_sources
from quillmatch.llm.near_dup import op6_near_dedup
from quillmatch.llm.quality_classifier import op10_quality_classifier
from quillmatch.llm.quality_rules import op7_quality_rules
from quillmatch.llm.substring import op1_substring_dedup
from quillmatch.llm.token_counts import op2_token_counts
from quillmatch.llm.url_filter import op5_url_filter

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_mix_sources": op3_mix_sources,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLES = {"op3_mix_sources": OP3_SQL, "op4_line_dedup": OP4_SQL}
