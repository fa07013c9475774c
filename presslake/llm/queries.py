"""The queries opN_<name> and pipeline, with the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presslake.llm import merkle, resampling, secrets, warc
from presslake.llm.ann import op4_nearest_neighbours
from presslake.llm.ball_tree import op7_exact_top_k
from presslake.llm.byte_bpe import op3_byte_bpe
from presslake.llm.jaccard_join import op5_jaccard_join
from presslake.llm.merkle import op11_merkle_manifest
from presslake.llm.packing import op10_best_fit_packing
from presslake.llm.quality import op2_quality_classifier
from presslake.llm.resampling import op13_importance_resampling
from presslake.llm.secrets import op1_secret_scan
from presslake.llm.token_counts import op8_token_counts
from presslake.llm.toxicity import op6_toxicity
from presslake.llm.warc import op12_warc
from presslake.llm.wrappers import op9_html_wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_toxicity": op6_toxicity,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_token_counts": op8_token_counts,
    "op9_html_wrappers": op9_html_wrappers,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_warc": op12_warc,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {"op1_secret_scan": secrets.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op12_warc": warc.ORACLE_SQL, "op13_importance_resampling": resampling.ORACLE_SQL}
