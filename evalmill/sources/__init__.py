"""Validated scans and the sinks that replace rows by source."""
