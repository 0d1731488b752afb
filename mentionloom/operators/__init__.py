"""Operators over long, flat tables of articles, mentions and associations."""
