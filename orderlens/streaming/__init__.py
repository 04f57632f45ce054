"""Keyed streaming state and the scoring job."""
