"""Byte-level BPE vocabularies of ``tokenizers`` JSON files, read as ranks of byte strings."""

from __future__ import annotations

import json

END_OF_WORD = b"\x01"


def _byte_of_char() -> dict[str, int]:
    """The usual byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest count up from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(bytes -> id of ordinary tokens, string -> id of added tokens).

    The file is read by each Python worker from its own installed copy.  An end-of-word suffix
    becomes the byte ``END_OF_WORD`` at a token's end.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    suffix = spec["model"].get("end_of_word_suffix") or ""
    table, ranks = _byte_of_char(), {}
    for token, rank in spec["model"]["vocab"].items():
        if token in added:
            continue
        ends = bool(suffix) and token.endswith(suffix)
        raw = bytes(table[c] for c in (token[: -len(suffix)] if ends else token))
        ranks[raw + END_OF_WORD if ends else raw] = rank
    return ranks, added


def split_added(text: str, added: dict[str, int]) -> list[tuple[str, int | None]]:
    """``text`` cut at added tokens, leftmost first: (ordinary text, id of the added token after it or None)."""
    parts: list[tuple[str, int | None]] = []
    while True:
        found = [(at, -len(s), s) for s in added if (at := text.find(s)) >= 0]
        if not found:
            return [*parts, (text, None)]
        at, _, s = min(found)
        parts.append((text[:at], added[s]))
        text = text[at + len(s) :]
