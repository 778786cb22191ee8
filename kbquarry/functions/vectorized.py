"""Small helpers over Arrow batches, for what has no built-in."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "nav", "footer", "header"}


class _Text(HTMLParser):
    """A flag, not a depth, says whether text is skipped"""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.parts = False, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip = self.skip or tag in SKIPPED

    def handle_endtag(self, tag: str) -> None:
        self.skip = self.skip and tag not in SKIPPED

    def handle_data(self, data: str) -> None:
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def _html(text: str | None) -> str | None:
    if text is None:
        return None
    p = _Text()
    p.feed(text)
    p.close()
    return "\n\n".join(p.parts)


def _html_series(html: pd.Series) -> pd.Series:
    return html.map(_html)


def html_to_text(html: Column | str) -> Column:
    """Made on use: a worker that imports this module has no session.  Nondeterministic, so that no plan runs it twice."""
    return F.pandas_udf(_html_series, "string").asNondeterministic()(html)


def link_mentions(names: list[str]) -> Callable:
    """The first whole-word place of each name of four letters or more, longest first, outside headings and lines
    that have a link"""
    known = sorted({n for n in names if len(n) >= 4}, key=lambda n: (-len(n), n))
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, known)) + r")\b") if known else None

    def one(body: str | None) -> str | None:
        if body is None or pattern is None:
            return body
        done: set[str] = set()

        def link(m: re.Match) -> str:
            if m[1] in done:
                return m[0]
            done.add(m[1])
            return f"[[{m[1]}]]"

        return "\n".join(line if line.startswith("#") or "[[" in line else pattern.sub(link, line) for line in body.split("\n"))

    @F.pandas_udf("string")
    def run(body: pd.Series) -> pd.Series:
        return body.map(one)

    return run
