"""Operators for preparing training corpora; nothing else in kinweave imports this subpackage."""
