"""Codestreams that arrive as files."""

from .arrivals import decode_arrivals, read_arrivals

__all__ = ["decode_arrivals", "read_arrivals"]
