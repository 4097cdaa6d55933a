"""Queries of the corpus operators, and SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lodestone.llm.brown import op2_brown_lm
from lodestone.llm.imatch import op5_imatch
from lodestone.llm.kdtree import OP8_SQL, op8_kdtree
from lodestone.llm.langid import op4_langid
from lodestone.llm.mixing import op3_mix
from lodestone.llm.negatives import OP11_SQL, op11_negatives
from lodestone.llm.packing import op7_pack
from lodestone.llm.pii import op9_pii
from lodestone.llm.quality import op10_quality
from lodestone.llm.resampling import op13_resample
from lodestone.llm.simhash import op1_simhash
from lodestone.llm.suffixes import op12_suffixes
from lodestone.llm.toxicity import op6_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (op1_simhash, op2_brown_lm, op3_mix, op4_langid, op5_imatch, op6_toxicity, op7_pack, op8_kdtree, op9_pii, op10_quality, op11_negatives, op12_suffixes, op13_resample)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op8_kdtree": OP8_SQL, "op11_negatives": OP11_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
