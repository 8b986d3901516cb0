"""Relational operators over cases, attempts, scores, tools, episodes and journals."""
