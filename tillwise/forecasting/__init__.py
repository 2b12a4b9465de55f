"""Autoregressive models for many series and many specifications in one job."""
