"""Genetic codes and column expressions on sequences."""
