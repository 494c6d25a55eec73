"""Schemas of the stored tiers and of the records in flight."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EVIDENCE = _of(source_date=T.DateType(), summary=S, source_id=S)
TURNS = _of(id=L, session_id=S, role=S, content=S, tool=S, token_count=I, created_at=TS, source_key=S, project=S, git_branch=S, tool_names=T.ArrayType(S))
CARDS = _of(id=L, session_id=S, period=S, summary=S, developer_behavior_facts=T.ArrayType(S), token_count=I, created_at=TS, updated_at=TS, narrative=S, open_threads=T.ArrayType(S), generated_by=S, model=S, extracted_at=TS)
MEMORIES = _of(id=L, content=S, namespace=S, category=S, embedding=T.ArrayType(T.FloatType()), created_at=TS, valid_at=TS, superseded_by=L, access_count=I, decay_factor=T.FloatType(), last_accessed_at=TS)
CANDIDATES = _of(id=L, description=S, supporting_evidence=T.ArrayType(EVIDENCE), counter_evidence=T.ArrayType(EVIDENCE), contexts=T.ArrayType(S), confidence=T.FloatType(), status=S, resolution_note=S, confirmed_memory_id=L, created_at=TS, updated_at=TS)
CURSORS = _of(source=S, path=S, bytes_read=L, turns_ingested=I, last_uuid=S, updated_at=TS)
PARSED = _of(source=S, session_id=S, source_key=S, role=S, text=S, created_at=TS, token_count=I, token_source=S, tool_names=T.ArrayType(S), cwd=S, project=S, git_branch=S, redactions=I)
MESSAGE = _of(role=S, content=S)
ATTEMPT = _of(index=I, raw=S, ok=B, errors=S, unfenced=B, input_tokens=I, output_tokens=I)
PREFERENCE = _of(content=S, category=S, confidence=D, evidence=S)
DRAFT = _of(narrative=S, highlights=T.ArrayType(S), preferences=T.ArrayType(PREFERENCE), open_threads=T.ArrayType(S))
PAIRS = _of(date=S, session_id=S, messages=T.ArrayType(MESSAGE), completion=DRAFT, meta=_of(provider=S, model=S, attempts=I, first_attempt_valid=B, extracted_at=S))
ATTEMPT_LOG = _of(date=S, session_id=S, provider=S, model=S, prompt_version=S, ok=B, first_attempt_valid=B, extracted_at=S, attempts=T.ArrayType(ATTEMPT))
