"""The open headings of a document, and the titles below which there are references only."""

from __future__ import annotations

import re

# Section titles whose subtrees hold references only.
REFERENCES = ("references", "bibliography", "参考文献")


def squeezed(text: str) -> str:
    return re.sub(r"[\t\n\f\r ]+", " ", text).strip()


class Headings:
    """The open headings; opening one closes those of its level and below."""

    def __init__(self) -> None:
        self.open_: list[tuple[int, str]] = []

    def open(self, level: int, title: str) -> None:
        self.open_ = [h for h in self.open_ if h[0] < level] + [(level, title)]

    def titles(self) -> list[str]:
        return [t for _, t in self.open_ if t]

    def path(self) -> str | None:
        return " / ".join(self.titles()) or None
