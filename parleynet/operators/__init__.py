"""Relational and graph operators over edges, articles and labels."""
