"""Dialogue data engine: DataFrame operators for building speech-dialogue training corpora."""
