"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op6_bpe
from .decontaminate import OP10_SQL, op10_decontamination
from .html_extract import op7_html_extraction
from .line_dedup import OP3_SQL, op3_line_dedup
from .ppm import op9_ppm
from .quality_gam import op1_quality_gam
from .quality_rules import op4_quality_rules
from .sharding import op2_sharding
from .simhash_dedup import op5_simhash
from .substring_dedup import op8_substring_dedup

QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_html_extraction": op7_html_extraction,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_ppm": op9_ppm,
    "op10_decontamination": op10_decontamination,
}
SQL = {"op3_line_dedup": OP3_SQL, "op10_decontamination": OP10_SQL}
