"""Structured Streaming counterparts of batch operators (an extension)."""
