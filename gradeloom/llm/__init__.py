"""Operators that prepare training text for language models. Nothing outside this folder imports it."""
