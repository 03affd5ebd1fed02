"""Readers, planners and writers of files and reports."""
