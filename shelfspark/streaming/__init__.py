"""Structured Streaming jobs. Every batch is written under its id, so a replayed batch replaces itself."""
