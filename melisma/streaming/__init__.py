"""Streaming forms: windows over event time, and running means of training logs as they are written."""
