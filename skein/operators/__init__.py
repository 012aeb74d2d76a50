"""Relational operators over the message model."""
