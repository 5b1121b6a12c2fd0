"""Composite jobs: whole engines and quality gates built from the operators."""
