"""Named queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
from corpus_pipeline import run as run_pipeline
from outage_spark.llm.conversation_trie import OP13_SQL, op13_conversation_trie
from outage_spark.llm.cross_polytope import op12_nearest_neighbours
from outage_spark.llm.decontamination import OP6_SQL, op6_decontamination
from outage_spark.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from outage_spark.llm.jaccard_join import op4_jaccard_join
from outage_spark.llm.license_scan import OP3_SQL, op3_license_scan
from outage_spark.llm.mixture import op7_mixture
from outage_spark.llm.personal_data import op9_personal_data
from outage_spark.llm.quality_rules import OP10_SQL, op10_quality_rules
from outage_spark.llm.repeated_passages import OP5_SQL, op5_repeated_passages
from outage_spark.llm.toxicity import op2_toxicity
from outage_spark.llm.token_rollup import OP8_SQL, byte_pair_rollup, op8_token_rollup
from outage_spark.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "pipeline": run_pipeline,
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_decontamination": op6_decontamination,
    "op7_mixture": op7_mixture,
    "op8_token_rollup": op8_token_rollup,
    "token_rollup_byte_pairs": byte_pair_rollup,
    "op9_personal_data": op9_personal_data,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_conversation_trie": op13_conversation_trie,
}

SQL = ({"pipeline": PIPELINE_SQL} if PIPELINE_SQL else {}) | {
    "op1_url_filter": OP1_SQL,
    "op3_license_scan": OP3_SQL,
    "op5_repeated_passages": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op8_token_rollup": OP8_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_conversation_trie": OP13_SQL,
}
