"""Whole queries composed of operators, and the catalogue of registered ones."""
