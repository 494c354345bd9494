"""Operators for training corpora; see ``registered`` for their queries."""
