"""Multi-step jobs: daily batch, repair, reports."""
