"""Operators for preparing training corpora. Nothing else in tallyforge imports this subpackage."""
