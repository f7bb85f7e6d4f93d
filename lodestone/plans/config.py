"""Settings: defaults, then a file, then the environment (LODESTONE__A__B), then overrides, merged deeply."""

from __future__ import annotations

import copy
import hashlib
import json
import os
from typing import Any

# The default settings.
DEFAULTS: dict[str, Any] = {
    "chunking": {"strategy": "section", "max_tokens": 512, "overlap": 64, "child_tokens": 128, "contextual_header": False},
    "ingestion": {"min_page_chars": 80, "header_footer_min_ratio": 0.5},
    "retrieval": {
        "type": "hybrid", "dense_top_k": 20, "sparse_top_k": 20, "rrf_k": 60, "dense_weight": 1.0, "sparse_weight": 1.0, "final_top_k": 8,
        "filter_mode": "restrict", "boost_ranks": 5, "infer_filters": True, "dedup_text_similarity": 0.9,
    },
    "reranker": {"enabled": False, "candidates": 30, "top_k": 6},
    "query": {"normalize": True, "rewriting": False, "multi_query": False, "multi_query_n": 3},
    "context": {"max_tokens": 6000, "max_chunks_per_document": 4, "neighbor_expansion": False, "neighbor_window": 1},
    "pricing": {},
}
PREFIX = "LODESTONE__"


def merge(base: dict, over: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def _value(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return text


def load(path: str | None = None, overrides: dict | None = None, env: dict[str, str] | None = None) -> dict[str, Any]:
    out = DEFAULTS
    if path:
        import yaml

        with open(path) as f:
            out = merge(out, yaml.safe_load(f) or {})
    for name, text in sorted((os.environ if env is None else env).items()):
        if name.startswith(PREFIX):
            node: Any = _value(text)
            for key in reversed(name[len(PREFIX) :].lower().split("__")):
                node = {key: node}
            out = merge(out, node)
    return merge(out, overrides or {})


def experiment_id(name: str, config: dict) -> str:
    """The name with a fingerprint of the configuration."""
    return f"{name}-{hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:8]}"
