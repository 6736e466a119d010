"""Operators for preparing large text corpora; nothing else in docframe imports this subpackage."""
