"""Operators that prepare text corpora for model training. Nothing outside this folder imports it."""
