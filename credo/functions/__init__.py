"""Column-level functions: every one returns a native Spark ``Column``."""

from credo.functions.text import (  # noqa: F401
    norm_affil, norm_context, norm_speaker, standardize_format, statement_length,
    strip_ws, word_tokens,
)
from credo.functions.labels import binary_label, cs_weight, cs_weight_hundredths, normalize_label  # noqa: F401
from credo.functions.scoring import (  # noqa: F401
    confidence_pct, decide, len_norm, length_bucket, sigmoid_prob,
)
