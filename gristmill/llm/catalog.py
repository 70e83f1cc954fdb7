"""The training-data queries and their DuckDB oracles."""

from __future__ import annotations

from .chat_format import OP9_SQL, op9_chat_format
from .decontaminate import OP4_SQL, op4_decontaminate
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .jaccard_join import OP6_SQL, op6_jaccard_join
from .language_id import op3_language_id
from .line_dedup import OP5_SQL, op5_line_dedup
from .mixing import OP13_SQL, op13_mixing
from .neighbours import op8_neighbours
from .packing import op1_best_fit_packing
from .periodic_runs import op12_periodic_runs
from .quality import op7_quality
from .secrets import op10_secrets
from .substring_dedup import op2_substring_dedup


def queries():
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_language_id": op3_language_id,
        "op4_decontaminate": op4_decontaminate,
        "op5_line_dedup": op5_line_dedup,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_quality": op7_quality,
        "op8_neighbours": op8_neighbours,
        "op9_chat_format": op9_chat_format,
        "op10_secrets": op10_secrets,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_mixing": op13_mixing,
    }


def oracle_sql():
    return {
        "op4_decontaminate": OP4_SQL,
        "op5_line_dedup": OP5_SQL,
        "op6_jaccard_join": OP6_SQL,
        "op9_chat_format": OP9_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op13_mixing": OP13_SQL,
    }
