"""Value kinds, comparisons, and functions on text."""
