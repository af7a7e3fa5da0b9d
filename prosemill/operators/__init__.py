"""Operators: the scanners of one document, and native DataFrame forms of them for whole tables."""
