"""Operators for training-data pipelines, one module each; nothing else imports them."""
