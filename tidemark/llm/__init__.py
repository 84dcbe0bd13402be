"""Operators for training-data pipelines over text; nothing else imports this package."""
