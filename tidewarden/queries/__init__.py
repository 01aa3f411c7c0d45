"""Registered queries, each with its SQL twin where SQL can express it on whole tables."""
