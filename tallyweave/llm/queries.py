"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe
from .conversation_trie import op13_trie
from .fm_index import op12_decontamination
from .langid import op4_language
from .line_crf import op9_rules
from .media import op1_media
from .minhash import op6_minhash
from .mixing import OP5_SQL, op5_mixing
from .packing import op3_packing
from .quality import op10_quality
from .resampling import op11_resampling
from .sharding import OP7_SQL, op7_sharding
from .suffix_dedup import op8_suffix


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_media, op2_bpe, op3_packing, op4_language, op5_mixing, op6_minhash, op7_sharding, op8_suffix, op9_rules, op10_quality, op11_resampling, op12_decontamination, op13_trie)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": OP5_SQL, "op7_sharding": OP7_SQL}
