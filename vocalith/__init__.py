"""Vocalith: the data plane of a multilingual content-to-speech workflow, on Spark."""
