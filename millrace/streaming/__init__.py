"""Streams of operational events."""
