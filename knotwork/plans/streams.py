"""Queries that run as streams over files, each with its checking SQL."""

from __future__ import annotations

import uuid

from knotwork.session import shared_folder
from knotwork.streaming import events

QUERIES, SQL = {}, {}


def stream_event_windows(spark, d):
    return events.drain(spark, d, "events", events.windowed, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


QUERIES["stream_event_windows"] = stream_event_windows
SQL["stream_event_windows"] = "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
