"""Suites: whole validations composed of the operators."""
