"""Spark jobs for security evidence: findings, facts, traces and verdicts as tables."""
