from .nodes import Collector, HashJoin, InMemoryScan, Node, Print, Projection, Selection, TableScan

__all__ = ["Collector", "HashJoin", "InMemoryScan", "Node", "Print", "Projection", "Selection", "TableScan"]
