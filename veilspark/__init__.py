"""Span detection, masking and policy analytics for personal data, expressed as Spark columns and tables."""
