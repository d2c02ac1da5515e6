"""Operators of a large-scale text corpus pipeline. Nothing outside this subpackage imports it."""
