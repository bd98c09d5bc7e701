"""Analytic templates, question triage and named queries."""
