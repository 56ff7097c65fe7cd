"""Whole queries: the request, the triage and its report."""
