"""Readers: tables, folder listings, manifests, configuration."""
