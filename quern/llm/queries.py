"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.collocations import OP12_SQL, op12_phrase_collocations
from quern.llm.conversations import op13_conversation_repair
from quern.llm.embedding_dedup import op3_embedding_dedup
from quern.llm.minhash_dedup import op5_minhash_dedup
from quern.llm.mixing import op1_source_mixing
from quern.llm.packing import op8_best_fit_packing
from quern.llm.quality_classifier import op2_quality_classifier
from quern.llm.quality_rules import op4_quality_rules
from quern.llm.repair import op9_repair_token_shards
from quern.llm.token_counts import op7_token_counts
from quern.llm.toxicity import op10_toxicity_ftrl
from quern.llm.url_filters import OP11_SQL, op11_url_filters
from quern.llm.warc_revisit import OP6_SQL, op6_warc_revisits


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_source_mixing, op2_quality_classifier, op3_embedding_dedup, op4_quality_rules, op5_minhash_dedup, op6_warc_revisits, op7_token_counts, op8_best_fit_packing, op9_repair_token_shards, op10_toxicity_ftrl, op11_url_filters, op12_phrase_collocations, op13_conversation_repair]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_revisits": OP6_SQL, "op11_url_filters": OP11_SQL, "op12_phrase_collocations": OP12_SQL}
