"""Operators for preparing training data. Nothing outside this folder imports it, but for the entry point's guard."""
