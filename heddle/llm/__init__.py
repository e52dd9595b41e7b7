"""Operators for training-data pipelines over texts and scores; nothing else imports this package."""
