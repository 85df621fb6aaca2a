"""Registered queries by area, each with the SQL that checks it."""
