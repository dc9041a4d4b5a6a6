"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fingerprints import op6_fingerprints
from .alignment import op13_alignment
from . import collocations, fixity
from .collocations import op12_collocations
from .fixity import op7_warc_fixity
from .html_extract import op8_html_extract
from .language_id import op10_language_id
from .near_dedup import op1_near_dedup
from .packing import op3_packing
from .quality import op11_quality
from .sharding import op5_sharding
from .suffix_dedup import op4_suffix_dedup
from .unigram import op2_sentencepiece
from .vector_dedup import op9_vector_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_sentencepiece, op3_packing, op4_suffix_dedup, op5_sharding, op6_fingerprints, op7_warc_fixity, op8_html_extract, op9_vector_dedup, op10_language_id, op11_quality, op12_collocations, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op7_warc_fixity": fixity.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL}
