"""Recognisers of source languages: a lexer each and a pushdown of open constructs."""
