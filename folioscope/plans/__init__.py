"""End-to-end jobs that chain readers, operators and writers."""
