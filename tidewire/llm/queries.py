"""The queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op13_alignment
from .decontamination import OP11_SQL, op11_decontamination
from .embedding_dup import op9_embedding_dups
from .language_id import op4_language_id
from .lexical import OP12_SQL, op12_lexical_search
from .mixing import OP6_SQL, op6_mixing
from .near_dup import op8_near_duplicates
from .nearest import op5_nearest
from .quality import op1_quality
from .sentencepiece_io import op2_sentencepiece
from .substring_dup import op3_substring_dedup
from .token_counts import op7_token_counts
from .token_files import op10_token_files

QUERIES = {
    "op1_quality": op1_quality,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_nearest": op5_nearest,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_embedding_dups": op9_embedding_dups,
    "op10_token_files": op10_token_files,
    "op11_decontamination": op11_decontamination,
    "op12_lexical_search": op12_lexical_search,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {"op6_mixing": OP6_SQL, "op11_decontamination": OP11_SQL, "op12_lexical_search": OP12_SQL}
