"""Whole surveys: alignment, export, depth models, object and crack detection.

Every plan works on tables with a `survey` column, so many recordings run side by side.
"""
