"""Batch relational operators over bars, stores and samples."""
