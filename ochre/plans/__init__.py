"""Whole analyses put together from sources and operators."""
