"""Readers, writers and the jobs that turn raw logs into the unified event schema."""
