"""Continuous maintenance of views from Structured Streaming sources."""
