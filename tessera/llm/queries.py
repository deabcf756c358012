"""Queries of the training-data operators, by name, and the SQL that some of them equal."""

from __future__ import annotations

from . import decontaminate, licenses, lm_scoring
from .decontaminate import op10_winnowing_decontamination
from .fingerprint import op6_multiset_fingerprints
from .licenses import op9_license_set_join
from .lm_scoring import op1_stupid_backoff_scores
from .mixing import op8_pivotal_mixing
from .quality import op3_bradley_terry_quality
from .sharding import op2_sampled_splitter_shards
from .simhash import op5_simhash_near_duplicates
from .suffix_dedup import op4_suffix_array_dedup
from .token_output import op7_feistel_token_output

QUERIES = {
    f.__name__: f
    for f in (
        op1_stupid_backoff_scores,
        op2_sampled_splitter_shards,
        op3_bradley_terry_quality,
        op4_suffix_array_dedup,
        op5_simhash_near_duplicates,
        op6_multiset_fingerprints,
        op7_feistel_token_output,
        op8_pivotal_mixing,
        op9_license_set_join,
        op10_winnowing_decontamination,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_stupid_backoff_scores": lm_scoring.ORACLE_SQL,
    "op9_license_set_join": licenses.ORACLE_SQL,
    "op10_winnowing_decontamination": decontaminate.ORACLE_SQL,
}
