"""Scans and sinks: capture files, the versioned sample store, JSON configs."""
