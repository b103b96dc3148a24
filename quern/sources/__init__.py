from .catalog import Attribute, Catalog, RelationSchema
from .ddl import ParserError, SchemaParser, parse

__all__ = ["Attribute", "Catalog", "ParserError", "RelationSchema", "SchemaParser", "parse"]
