"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op9_bpe
from .chat import OP10_SQL, op10_chat_format
from .hamming import OP1_SQL, op1_hamming_topk
from .html_text import op8_html_text
from .jaccard import OP2_SQL, op2_jaccard
from .langid import op6_language
from .line_dedup import OP4_SQL, op4_line_dedup
from .lm_select import op7_lm_score
from .mixing import OP5_SQL, op5_source_mix
from .phrases import OP11_SQL, op11_phrases
from .piece_bpe import op13_piece_bpe
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op3_quality

QUERIES = {
    "op1_hamming_topk": op1_hamming_topk,
    "op2_jaccard": op2_jaccard,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_source_mix": op5_source_mix,
    "op6_language": op6_language,
    "op7_lm_score": op7_lm_score,
    "op8_html_text": op8_html_text,
    "op9_bpe": op9_bpe,
    "op10_chat_format": op10_chat_format,
    "op11_phrases": op11_phrases,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_piece_bpe": op13_piece_bpe,
}

ORACLE_SQL = {
    "op1_hamming_topk": OP1_SQL,
    "op2_jaccard": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_source_mix": OP5_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_phrases": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
