"""What the driver's entry point adds: the operators' queries, the pipeline, their SQL."""

from __future__ import annotations

import corpus_pipeline
from confluo.llm.oracle import ORACLE
from confluo.llm.queries import QUERIES

LLM_QUERIES = {**QUERIES, "pipeline": corpus_pipeline.run}
LLM_ORACLE = dict(ORACLE)
