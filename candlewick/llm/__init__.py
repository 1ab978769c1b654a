"""Operators for preparing training corpora; nothing else in the package imports this subpackage."""
