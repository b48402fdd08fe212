"""Run-status folding, batch and streaming."""
