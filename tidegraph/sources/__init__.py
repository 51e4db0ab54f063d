"""Readers of question sets and corpora, splitters, and the tables the engine keeps."""
