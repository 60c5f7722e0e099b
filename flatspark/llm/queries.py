"""Queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from .decontamination import op6_decontamination
from .langid import op3_language_id
from .lm_scoring import op1_lm_scoring
from .media import op8_media
from .near_dedup import op7_near_dedup
from .packing import op2_packing
from .secrets_scan import op5_secrets
from .token_counts import op9_token_counts
from .toxicity import op4_toxicity
from .warc import op10_warc

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_decontamination": op6_decontamination,
    "op7_near_dedup": op7_near_dedup,
    "op8_media": op8_media,
    "op9_token_counts": op9_token_counts,
    "op10_warc": op10_warc,
}
ORACLES: dict[str, str] = {}
