"""Structured Streaming: windows, state, replays, corrected rows."""
