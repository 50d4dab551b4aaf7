"""Incremental jobs."""

from keyfold.streaming.incremental import stream_job, stream_lines

__all__ = ["stream_job", "stream_lines"]
