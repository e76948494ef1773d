"""Readers of corpora and manifests, and checks of what they hold."""
