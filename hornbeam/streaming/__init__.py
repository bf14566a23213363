"""Structured Streaming: micro-batches that feed incremental maintenance."""

from .feed import feed

__all__ = ["feed"]
