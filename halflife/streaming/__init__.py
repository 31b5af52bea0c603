"""Incremental (Structured Streaming) forms of the weekly activity reports."""

from halflife.streaming.activity import (  # noqa: F401
    LINE_EVENT_SCHEMA,
    active_lines_snapshot,
    start_weekly_activity,
    to_line_events,
    weekly_counts,
    weekly_people,
)
