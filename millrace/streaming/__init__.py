"""Bounded increments of growing sources, and the positions they leave behind."""
