"""Kept for streaming plans. Detection reads finished logs, in which rows never come late, so there are none."""
