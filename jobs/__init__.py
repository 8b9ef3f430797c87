"""Runnable jobs: `python -m jobs.season_update`, `python -m jobs.delivery_audit`."""
