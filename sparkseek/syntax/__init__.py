"""Tokens and parsing-expression grammars of the source languages."""
