"""Queries of the training-data operators and the SQL that expresses them."""

from __future__ import annotations

from .bpe import op2_bpe
from .chat import op3_chat
from .exact import OP6_SQL, op6_exact
from .linededup import OP9_SQL, op9_line_templates
from .mixing import OP8_SQL, op8_mixing
from .nearjoin import op10_ngram_jaccard
from .quality import op5_quality
from .secrets import op7_secrets
from .sketch import op4_sketch
from .toxic import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_chat": op3_chat,
    "op4_sketch": op4_sketch,
    "op5_quality": op5_quality,
    "op6_exact": op6_exact,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_line_templates": op9_line_templates,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact": OP6_SQL,
    "op8_mixing": OP8_SQL,
    "op9_line_templates": OP9_SQL,
}
