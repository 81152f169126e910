"""Stateful per-rider operators."""
