"""Reusable plan shapes: ordered scans over hot keys, exact order statistics, spatial candidate joins."""
