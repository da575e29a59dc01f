"""Runnable jobs: each module has a command line, and ``run``, which takes a session; the JSON file of the same name is its configuration."""
