"""Scans, with the reading mode that each contract asks for, and sinks."""
