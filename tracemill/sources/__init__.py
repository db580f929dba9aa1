"""Readers of transcripts and logs."""
