"""Analyses as DataFrame-to-DataFrame functions."""
