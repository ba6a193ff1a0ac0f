"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .alignment import op13_alignment
from .bpe import op3_bpe
from .classifier import op7_classifier
from .jaccard import OP8_SQL, op8_jaccard
from .language import op11_language
from .licenses import OP2_SQL, op2_licenses
from .lines import OP6_SQL, op6_lines
from .lm import op10_lm
from .media import op9_media
from .mixing import OP1_SQL, op1_mixing
from .negatives import OP12_SQL, op12_negatives
from .rules import OP5_SQL, op5_rules
from .suffixes import op4_suffixes

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_licenses": op2_licenses,
    "op3_bpe": op3_bpe,
    "op4_suffixes": op4_suffixes,
    "op5_rules": op5_rules,
    "op6_lines": op6_lines,
    "op7_classifier": op7_classifier,
    "op8_jaccard": op8_jaccard,
    "op9_media": op9_media,
    "op10_lm": op10_lm,
    "op11_language": op11_language,
    "op12_negatives": op12_negatives,
    "op13_alignment": op13_alignment,
}
ORACLES = {"op1_mixing": OP1_SQL, "op2_licenses": OP2_SQL, "op5_rules": OP5_SQL, "op6_lines": OP6_SQL, "op8_jaccard": OP8_SQL, "op12_negatives": OP12_SQL}
