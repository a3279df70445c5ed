"""Reusable views, the stored monthly table, and the jobs that write."""
