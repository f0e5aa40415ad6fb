"""The corpus operators' queries."""

from __future__ import annotations

from . import near_dedup, quality_rules, warc
from .byte_bpe import op6_byte_bpe
from .near_dedup import op9_near_dedup
from .nn_descent import op8_nearest
from .packing import op5_packing
from .pii import op3_pii
from .quality_classifier import op10_quality_classifier
from .quality_rules import op7_quality_rules
from .token_counts import op1_token_counts
from .token_files import op2_token_files
from .warc import op4_warc

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_token_files": op2_token_files,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_nearest": op8_nearest,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLE_SQL: dict[str, str] = {"op4_warc": warc.ORACLE_SQL, "op7_quality_rules": quality_rules.ORACLE_SQL, "op9_near_dedup": near_dedup.ORACLE_SQL}
