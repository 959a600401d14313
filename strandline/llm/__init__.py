"""Operators for preparing training corpora. Nothing else imports this package."""
