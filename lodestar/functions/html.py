"""Text of HTML pages, block by block."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that hold no text, and elements that begin and end a line.
SKIPPED = frozenset("script style head noscript template".split())
BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer blockquote pre hr dd dt".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self._deep = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._deep += tag in SKIPPED
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and self._deep:
            self._deep -= 1
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self._deep:
            self.parts.append(data)


def text_of(html: str | None) -> str:
    """A line for each block, blanks within it joined; one empty line at most between lines."""
    reader = _Text()
    reader.feed(html or "")
    reader.close()
    out: list[str] = []
    for line in "".join(reader.parts).split("\n"):
        line = " ".join(line.split())
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(text_of)
