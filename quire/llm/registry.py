"""Queries and DuckDB statements of the ``llm`` operators."""

from __future__ import annotations

from quire.llm import (bin_pack, cgk_decontaminate, chat_quotes, compress_quality, license_rules, mixture_packing, page_diff,
                       setsketch_dedup, source_mix, stupid_backoff, subspace_dedup, token_alignment, whitening)

_MODULES = (page_diff, cgk_decontaminate, stupid_backoff, chat_quotes, bin_pack, license_rules, compress_quality, source_mix,
            setsketch_dedup, subspace_dedup, token_alignment, mixture_packing, whitening)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
# SQL states operator 10 in full; the others are compared with brute force in tests/llm.
ORACLE = dict(subspace_dedup.ORACLE)
