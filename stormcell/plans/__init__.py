"""Composed jobs: feature build, serving decisions, training, scoring."""
