"""Models over streams: row-by-row models run continuously."""

from .append import append_stream, streamable

__all__ = ["append_stream", "streamable"]
