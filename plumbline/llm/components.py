"""Components of links between texts."""

from plumbline.operators.graphs import components as connected

__all__ = ["connected"]
