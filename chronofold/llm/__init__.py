"""Operators that prepare text corpora for training; nothing else in chronofold imports them."""
