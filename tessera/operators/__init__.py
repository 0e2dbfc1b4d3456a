"""Tessera: operators."""
