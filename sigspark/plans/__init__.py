"""The six jobs as DataFrame plans."""
