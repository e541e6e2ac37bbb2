"""Operators of the hotspot engine, as DataFrame functions."""
