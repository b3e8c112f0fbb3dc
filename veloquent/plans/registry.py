"""Collects the queries of all operator groups."""

from __future__ import annotations

from . import policies, scores, sequential, service, text, timeline, transcript, transcript_json
from .base import Query

GROUPS = (transcript.query, service.query, timeline.query, text.query, scores.query, transcript_json.query, sequential.query, policies.query)


def queries() -> dict[str, Query]:
    return {name: f for group in GROUPS for name, f in group.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.sql.items()}
