"""Registered queries; importing the package fills the registry."""

from tablecraft.suite import (  # noqa: F401
    connections, evolutions, expressions, history, increments, layouts, models, streams, texts,
)
from tablecraft.suite.registry import ORACLES, QUERIES  # noqa: F401
