"""Configuration: a tree of defaults, dotted paths, typed patches.

A patch changes one call's settings and leaves the stored ones alone.
"""

from __future__ import annotations

import copy
import json
import re
from typing import Any

from .errors import BadRequest

#: The defaults that all rankings depend on.
DEFAULTS: dict[str, Any] = {
    "language": {"gate": "strict", "gateCodeBlocks": False},
    "chunking": {
        "strategies": {
            "fine": {"targetTokens": 120, "overlap": 0, "minTokens": 30},
            "coarse": {"targetTokens": 400, "overlap": 0.15, "minTokens": 50},
        },
        "prependHeadings": True,
        "indexCode": True,
    },
    "keywords": {"topNKeywords": 12, "topNPhrases": 6, "minScore": 0.35, "autoWeight": 1, "promoteMinDf": 3, "promoteMinScore": 0.5},
    "search": {
        "mode": "hybrid",
        "hybridWeights": {"text": 0.5, "vector": 0.5},
        "strategyWeights": {"fine": 1, "coarse": 0.9},
        "fusion": {"chunk": 0.7, "meta": 0.3, "lambdaMultiChunk": 0.15},
        "boost": {"title": 3, "aliases": 2.5, "keywordsManual": 2.5, "keywordsAuto": 1.5, "phrasesManual": 2, "phrasesAuto": 1.2, "outline": 1.5},
        "graph": {"boost": 0.15, "expandDepth": 1, "expandMinVotes": 2},
        "limits": {"candidateK": 150, "resultK": 10, "minSimilarity": 0.25},
        "tolerance": 1,
    },
}


def defaults() -> dict:
    return copy.deepcopy(DEFAULTS)


def merge(base: dict, over: dict) -> dict:
    """over's values on top of base's, tree by tree."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def flatten(tree: dict, prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in tree.items():
        path = f"{prefix}{k}"
        out |= flatten(v, f"{path}.") if isinstance(v, dict) else {path: v}
    return out


def read(tree: dict, path: str) -> Any:
    node: Any = tree
    for key in path.split("."):
        if not isinstance(node, dict) or key not in node:
            raise BadRequest(f'no setting "{path}"', {"path": path}, "see flatten(defaults()) for all settings")
        node = node[key]
    return node


def _check(path: str, old: Any, new: Any) -> None:
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    fits = number(new) if number(old) else type(new) is type(old)
    if not fits:
        raise BadRequest(f'"{path}" needs a {type(old).__name__}, not {new!r}', {"path": path, "value": new})


def apply_patch(tree: dict, patch: dict[str, Any]) -> dict:
    """A copy of tree with dotted paths set; paths must exist and types agree."""
    out = copy.deepcopy(tree)
    for path, value in patch.items():
        _check(path, read(tree, path), value)
        *way, last = path.split(".")
        node = out
        for key in way:
            node = node[key]
        node[last] = value
    return out


def coerce(text: str) -> Any:
    """A command line's text as a number, a boolean or itself."""
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return float(text) if "." in text else int(text)
    return text


def resolve_weights(config: dict, mode: str, text: float | None = None, vector: float | None = None) -> tuple[float, float]:
    """What the lexical and the vector half count in a mode."""
    if mode == "semantic":
        return 0.0, 1.0
    if mode == "lexical":
        return 1.0, 0.0
    base = config["search"]["hybridWeights"]
    text = base["text"] if text is None else text
    vector = base["vector"] if vector is None else vector
    if text < 0 or vector < 0 or text + vector == 0:
        raise BadRequest("weights must not be negative, nor both zero", {"text": text, "vector": vector})
    return float(text), float(vector)


def metadata_boosts(config: dict) -> dict[str, float]:
    """What each metadata field's score counts; tags count as aliases do."""
    b, auto = config["search"]["boost"], config["keywords"]["autoWeight"]
    out = {"title": b["title"], "aliases": b["aliases"], "keywordsManual": b["keywordsManual"], "keywordsAuto": b["keywordsAuto"] * auto, "phrasesManual": b["phrasesManual"], "phrasesAuto": b["phrasesAuto"] * auto, "tags": b["aliases"], "outline": b["outline"]}
    return {k: float(v) for k, v in out.items()}


def stable_json(value: Any) -> str:
    """JSON with sorted keys and no blanks, for hashing."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
