"""Reading lines, articles and seeds; writing relations and statistics."""

from pairloom.sources.lines import parse_articles, parse_seeds, read_lines, rejected_articles, union_lines
from pairloom.sources.sinks import format_relations, write_relations, write_table

__all__ = [
    "format_relations",
    "parse_articles",
    "parse_seeds",
    "read_lines",
    "rejected_articles",
    "union_lines",
    "write_relations",
    "write_table",
]
