"""Whole jobs: preparation, model fitting, tuning and scoring."""
