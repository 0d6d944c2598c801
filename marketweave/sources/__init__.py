"""Shaping of raw payloads into typed rows."""
