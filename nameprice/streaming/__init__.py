"""Structured Streaming: live leaderboard and streamed row features."""
