"""Declarative entity specs and the queries built from them."""
