"""Markdown reports from aggregated rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

_BLOCK = re.compile(r"<!-- MANUAL:(?P<key>[\w-]+) -->(?P<body>.*?)<!-- /MANUAL:(?P=key) -->", re.DOTALL)


def table(rows: Iterable[Sequence[object]], header: Sequence[str]) -> str:
    shown = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(header) + " |", "|" + "---|" * len(header)]
    return "\n".join([*lines, *("| " + " | ".join(map(shown, r)) + " |" for r in rows)])


def frame_table(frame: DataFrame) -> str:
    """A small aggregated frame as a table; reports are summaries, so their rows are few."""
    return table(frame.collect(), frame.columns)


def manual_blocks(old: str) -> dict[str, str]:
    """Hand-written blocks of an earlier report, by key."""
    return {m["key"]: m["body"] for m in _BLOCK.finditer(old)}


def restore_blocks(new: str, blocks: dict[str, str]) -> str:
    return _BLOCK.sub(lambda m: f"<!-- MANUAL:{m['key']} -->{blocks.get(m['key'], m['body'])}<!-- /MANUAL:{m['key']} -->", new)


def dataset_report(balance: DataFrame, lengths: DataFrame, sources: DataFrame) -> str:
    return "\n\n".join(["# Dataset", "## Balance", frame_table(balance), "## Words", frame_table(lengths), "## Sources", frame_table(sources)])


def evaluation_report(report: DataFrame, confusion: DataFrame, by_source: DataFrame, gap: DataFrame, worst: DataFrame, old: str = "") -> str:
    notes = "<!-- MANUAL:notes -->\n<!-- /MANUAL:notes -->"
    body = "\n\n".join(["# Evaluation", "## Held-out rows", frame_table(report), frame_table(confusion), "## By source", frame_table(by_source), "## Gap", frame_table(gap), "## Worst errors", frame_table(worst), "## Notes", notes])
    return restore_blocks(body, manual_blocks(old))
