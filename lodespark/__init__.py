"""Repository-knowledge analytics as DataFrame functions."""
