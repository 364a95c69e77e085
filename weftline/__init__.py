"""weftline: bipartite interaction analytics on PySpark DataFrames."""

from weftline.engine import Engine, InteractionGraph, connect, load

__all__ = ["Engine", "InteractionGraph", "connect", "load"]
__version__ = "0.1.0"
