"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .centroids import OP13_SQL, op13_centroids
from .decontam import OP7_SQL, op7_decontamination
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .html import op11_html_text
from .langid import op6_language_id
from .lmscore import OP10_SQL, op10_lm_scoring
from .ngram_join import OP8_SQL, op8_ngram_join
from .pii import op4_pii
from .quality import op1_quality
from .runs import op12_periodic_runs
from .sentencepiece_codec import op5_sentencepiece
from .sharding import op3_sharding
from .substring import OP9_SQL, op9_substring_dedup


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_exact_dedup, op3_sharding, op4_pii, op5_sentencepiece, op6_language_id, op7_decontamination, op8_ngram_join, op9_substring_dedup, op10_lm_scoring, op11_html_text, op12_periodic_runs, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op7_decontamination": OP7_SQL, "op8_ngram_join": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op10_lm_scoring": OP10_SQL, "op13_centroids": OP13_SQL}
