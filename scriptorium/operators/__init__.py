"""Operators over pages, boxes, words, replies, jobs and measurements: DataFrames in, DataFrames out."""
