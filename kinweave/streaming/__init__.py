"""Streaming forms of batch operators (an extension: the batch rules have no clock)."""
