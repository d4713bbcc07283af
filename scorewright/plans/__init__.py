"""Whole stages: sample, recode, reduce; and their settings."""
