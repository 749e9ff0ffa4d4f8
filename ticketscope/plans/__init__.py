"""Composite plans: summary routing, batch refresh, the named query catalog."""
