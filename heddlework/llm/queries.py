"""The queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import importance, licenses, merkle, quality
from .decontamination import op1_decontamination
from .html import op8_html
from .importance import op13_importance
from .jaccard import op10_jaccard
from .langid import op11_langid
from .licenses import op5_licences
from .lmscore import op3_lm_scoring
from .merkle import op12_merkle
from .mixing import op6_mixing
from .pii import op4_pii
from .quality import op9_quality
from .suffixes import op2_suffix_dedup
from .toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_pii": op4_pii,
    "op5_licences": op5_licences,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_html": op8_html,
    "op9_quality": op9_quality,
    "op10_jaccard": op10_jaccard,
    "op11_langid": op11_langid,
    "op12_merkle": op12_merkle,
    "op13_importance": op13_importance,
}
ORACLES: dict[str, str] = {"op5_licences": licenses.ORACLE, "op9_quality": quality.ORACLE, "op12_merkle": merkle.ORACLE, "op13_importance": importance.ORACLE}
