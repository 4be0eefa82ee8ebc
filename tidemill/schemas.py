"""Schemas of the notice tables; readers use these and never infer."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _d, _b = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RAW_ITEM = _of(
    ord=_l, id=_s, title_ja=_s, source_name=_s, source_url=_s, published_at=_s, fetched_at=_s, source_language=_s, raw_summary=_s,
    raw_content_hash=_s, source_type=_s, first_seen_at=_s, stage_hint=_s, comment_deadline=_s,
)
TRANSLATION = _of(title=_s, summary=_s, business_impact=_s, recommended_action=_s)
PUBLISHED_ITEM = _of(
    rank=_l, id=_s, title_en=_s, title_ja=_s, area=_s, stage=_s, impact_level=_s, summary_en=_s, business_impact_en=_s, recommended_action_en=_s,
    source_name=_s, source_url=_s, published_at=_s, last_checked=_s, relevance_score=_d, first_seen_at=_s, comment_deadline=_s,
    comment_deadline_source=_s, comment_deadline_source_id=_s, comment_deadline_inherited=_b, summary_source=_s, confidence=_s,
    translations=T.MapType(_s, TRANSLATION),
)
FETCH_REPORT = _of(source_key=_s, source_name=_s, source_url=_s, status=_s, fetched_count=_l, new_count=_l, latest_published_at=_s, duration_ms=_l, error_type=_s, error_message=_s)
SOURCE_STATE = _of(source_key=_s, consecutive_zero_runs=_l, consecutive_error_runs=_l, last_status=_s, last_problem_at=_s, last_recovered_at=_s)
TIMELINE_EVENT = _of(dossier_key=_s, when=T.DateType(), rank=T.IntegerType(), label=_s, detail=_s, item_ids=T.ArrayType(_s), source_url=_s)
