"""Spans of kinds in a text."""

from __future__ import annotations

from collections.abc import Sequence

KindSpan = tuple[int, int, int]  # number of the kind, start, end (exclusive), in code points


def spans_text(spans: Sequence[KindSpan], kinds: Sequence[str]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(
        f"{kinds[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2]))
    )
