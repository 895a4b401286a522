"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from veilgrid.llm import oracles
from veilgrid.llm import queries as q


def queries():
    found = {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    found = {"op3_fragment_join": oracles.NGRAM_JOIN, "op4_winnowing": oracles.LINE_DEDUP, "op5_chat_format": oracles.CHAT_FORMAT}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
