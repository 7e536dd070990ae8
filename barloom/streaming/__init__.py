"""Structured Streaming forms: event-time bars, an order book in keyed state, sinks."""
