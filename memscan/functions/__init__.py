from .numeric import (clamp, clamp_min, dlit, finite_or, is_finite, k_of,  # noqa: F401
                      nan_to_num, safe_div, safe_sqrt)
from .text import (clean_text, compressed_length, format_percent,  # noqa: F401
                   parse_percent, token_array, word_count)
