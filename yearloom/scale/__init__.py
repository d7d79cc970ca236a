from .groups import hot_groups, keyed_join, lookup, sized
from .written import checkpoint_root, materialise, release, remembered, row_count, written_so_far
from .quantiles import grouped, modes, number
from .ranges import chunks, indexed, lagged, sample_mark, sample_rows
from .workers import ship

__all__ = [
    "checkpoint_root", "chunks", "grouped", "hot_groups", "indexed", "keyed_join", "lagged",
    "lookup", "materialise", "modes", "number", "release", "remembered", "row_count", "sample_mark", "sample_rows", "ship", "sized", "written_so_far",
]
