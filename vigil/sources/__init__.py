"""Readers and parsers: manifests, lockfiles, intelligence feeds, source trees; and the sinks."""
