"""The page operators over streams: sources, windows with late data, sessions, running state."""

from .events import counts_by_window, dedupe, read_events, running_totals, sessions, write_once

__all__ = ["counts_by_window", "dedupe", "read_events", "running_totals", "sessions", "write_once"]
