"""Runnable jobs over the library: one module each, with a command line and a small configuration file beside it."""
