from panelspark.functions.bits import (
    TENURE_PERIODS, bits_of, has_item, held_names, item_numbers, known_mask, mask_column, names_of, tenure_of,
)
from panelspark.functions.fixedpoint import micro, pseudo_random
from panelspark.functions.ranking import ap_at_k, ap_at_k_bits, best_open, full_order, top_k

__all__ = [
    "TENURE_PERIODS",
    "ap_at_k", "ap_at_k_bits", "best_open", "bits_of", "full_order", "has_item", "held_names", "item_numbers",
    "known_mask", "mask_column", "micro", "names_of", "pseudo_random", "tenure_of", "top_k",
]
