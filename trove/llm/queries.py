"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from trove.llm import html_text, line_dedup, mixing, order_minhash, quality, sentence_pieces, sharding, spotsigs, substring_dedup, url_filter

_MODULES = (html_text, line_dedup, mixing, order_minhash, quality, sentence_pieces, sharding, spotsigs, substring_dedup, url_filter)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
