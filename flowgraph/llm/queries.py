"""The queries of this subpackage and their SQL equivalents, where SQL can express them."""

from __future__ import annotations

from .common import importable
from .attention import op12_lm_scores
from .divergence import OP13_SQL, op13_divergence
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .language import op10_language
from .negatives import OP11_SQL, op11_negatives
from .pii import op7_pii
from .quality import OP3_SQL, op3_quality_rules
from .pieces import op2_sentencepiece
from .simhash import op9_simhash
from .suffix_dedup import op5_suffix_dedup
from .tokens import op6_token_files, op8_packing
from .url_filter import OP4_SQL, op4_url_filter


QUERIES = {
    name: importable(query)
    for name, query in {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_quality_rules": op3_quality_rules,
        "op4_url_filter": op4_url_filter,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_token_files": op6_token_files,
        "op7_pii": op7_pii,
        "op8_packing": op8_packing,
        "op9_simhash": op9_simhash,
        "op10_language": op10_language,
        "op11_negatives": op11_negatives,
        "op12_lm_scores": op12_lm_scores,
        "op13_divergence": op13_divergence,
    }.items()
}

ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op3_quality_rules": OP3_SQL,
    "op4_url_filter": OP4_SQL,
    "op11_negatives": OP11_SQL,
    "op13_divergence": OP13_SQL,
}
