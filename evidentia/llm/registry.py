"""The operators' queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import exactdedup, linededup, merkle, pii, resampling, warc
from .ann import op6_small_world
from .exactdedup import op12_content_sort
from .linededup import op4_line_dedup
from .merkle import op11_lookup_proofs
from .mixing import op3_entropy_mix
from .pii import op5_personal_data
from .packing import op10_best_two_fit
from .quality import op7_quality_rules
from .resampling import op13_word_trie_resampling
from .scoring import op8_log_bilinear
from .simhash import op9_simhash_pigeonring
from .urls import op1_url_filter
from .warc import op2_warc_histories

QUERIES = {f.__name__: f for f in (op1_url_filter, op2_warc_histories, op3_entropy_mix, op4_line_dedup, op5_personal_data, op6_small_world, op7_quality_rules, op8_log_bilinear, op9_simhash_pigeonring, op10_best_two_fit, op11_lookup_proofs, op12_content_sort, op13_word_trie_resampling)}
ORACLES = {"op2_warc_histories": warc.oracle(), "op4_line_dedup": linededup.ORACLE, "op5_personal_data": pii.oracle(), "op11_lookup_proofs": merkle.oracle(), "op12_content_sort": exactdedup.ORACLE, "op13_word_trie_resampling": resampling.oracle()}


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
