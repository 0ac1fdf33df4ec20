"""Streaming replays."""
