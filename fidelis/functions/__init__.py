"""Scalar building blocks: metric specifications, pixel formats, color and score functions."""
