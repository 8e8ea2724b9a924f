"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from fleetframe.llm.ann import op3_ann
from fleetframe.llm.conversations import op11_conversations
from fleetframe.llm.decontam import OP7_SQL, op7_decontam
from fleetframe.llm.langid import op1_langid
from fleetframe.llm.negatives import OP13_SQL, op13_negatives
from fleetframe.llm.packing import op6_packing
from fleetframe.llm.pii import op2_pii
from fleetframe.llm.quality import op8_quality
from fleetframe.llm.rules import OP12_SQL, op12_rules
from fleetframe.llm.secrets import op9_secrets
from fleetframe.llm.sharding import op10_shards
from fleetframe.llm.simhash import op5_simhash
from fleetframe.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_langid": op1_langid,
    "op2_pii": op2_pii,
    "op3_ann": op3_ann,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_decontam": op7_decontam,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_shards": op10_shards,
    "op11_conversations": op11_conversations,
    "op12_rules": op12_rules,
    "op13_negatives": op13_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": OP4_SQL,
    "op7_decontam": OP7_SQL,
    "op12_rules": OP12_SQL,
    "op13_negatives": OP13_SQL,
}
