from .fixtures import (MIXED_EVENTS_SPEC, MIXED_LINES_SPEC, MIXED_ORDERS_SPEC, SPARSE_LINES_DIM,
                       WIDE_EMBEDDINGS_SPEC, mixed_events, mixed_lines, mixed_orders, sparse_lines,
                       table, wide_embeddings)
from .files import read_libsvm, read_positional_csv, write_libsvm
from .rejects import read_csv_with_rejects, read_libsvm_with_rejects
