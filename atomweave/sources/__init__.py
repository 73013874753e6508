from .models import Dictionary, init_dictionary, load_dictionary, matrix_to_table, table_to_matrix
from .sinks import write_codes
from .text import numbered_lines, read_entries, read_flat_matrix, read_signals

__all__ = [
    "Dictionary", "init_dictionary", "load_dictionary", "matrix_to_table", "table_to_matrix",
    "write_codes", "numbered_lines", "read_entries", "read_flat_matrix", "read_signals",
]
