"""Disclosure analytics as DataFrame transformations over many companies at once."""
