from .snippets import (SNIPPET_SCHEMA, benchmark_snippets, documents_snippets,  # noqa: F401
                       load_snippets, member_rule, select_fields, table)
from .token_stats import (ALT_STATS_SCHEMA, TOKEN_STATS_SCHEMA, load_alt_stats,  # noqa: F401
                          load_token_stats)
from .sinks import results_name, results_suffix, write_results  # noqa: F401
