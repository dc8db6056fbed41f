"""Operators of a training-data pipeline over large text corpora; nothing outside this subpackage imports it."""
