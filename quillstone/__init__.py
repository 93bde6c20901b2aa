"""Spark-first analytics for screened documents, judgments and their evaluation."""
