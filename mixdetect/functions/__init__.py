from .columns import modular_hash, rounded, row_hash, selection_cutoff, xx_hash
from . import sql
