"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from .byte_bpe import op2_byte_bpe
from .chat_format import OP8_SQL, op8_chat_format
from .collocations import OP11_SQL, op11_collocations
from .decontaminate import op3_decontaminate
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .importance import op9_importance
from .lexical_search import OP12_SQL, op12_lexical_search
from .near_dedup import op10_near_dedup
from .quality_rules import op13_quality_rules
from .secret_scan import OP1_SQL, op1_secret_scan
from .substring_dedup import op5_substring_dedup
from .toxicity import op7_toxicity
from .url_filter import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_chat_format": op8_chat_format,
    "op9_importance": op9_importance,
    "op10_near_dedup": op10_near_dedup,
    "op11_collocations": op11_collocations,
    "op12_lexical_search": op12_lexical_search,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE = {
    "op1_secret_scan": OP1_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op6_url_filter": OP6_SQL,
    "op8_chat_format": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
}
