"""Masking of streams, batch by batch."""
