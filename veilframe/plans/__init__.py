"""Treatment plans: sharing purposes, the per-column configuration, and its application."""
