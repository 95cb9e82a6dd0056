"""Operators for preparing training text; nothing else in factlake imports this subpackage."""
