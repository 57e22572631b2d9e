"""Readers of message logs, the run log, and the sinks."""
