"""Statements over growing folders of delimited files, by Structured Streaming."""

from querl.streaming.files import stream_table

__all__ = ["stream_table"]
