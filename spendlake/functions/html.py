"""HTML to text.

The text nodes of a page, each stripped, empties left out, one per line.
Script, style and template content, comments, declarations and processing
instructions are no text.
"""

from collections import Counter
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that never have content, and elements whose content
# is no text.
_VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
_HIDDEN = frozenset(("script", "style", "template"))


class _Nodes(HTMLParser):
    """Collects text nodes; a node ends at a tag or a comment, not at an entity."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.done = []
        self.node = []
        self.open = []
        self.times = Counter()
        self.hidden = 0

    def end_node(self):
        text = "".join(self.node).strip()
        if text and not self.hidden:
            self.done.append(text)
        self.node = []

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag not in _VOID:
            self.open.append(tag)
            self.times[tag] += 1
            self.hidden += tag in _HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.end_node()

    def handle_endtag(self, tag):
        self.end_node()
        if self.times[tag]:
            closed = None
            while closed != tag:
                closed = self.open.pop()
                self.times[closed] -= 1
                self.hidden -= closed in _HIDDEN

    def handle_data(self, data):
        self.node.append(data)

    def handle_charref(self, name):
        self.node.append(unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self.node.append(html5.get(name + ";", "&" + name))

    def handle_comment(self, data):
        self.end_node()

    handle_decl = handle_comment
    handle_pi = handle_comment

    def unknown_decl(self, data):
        self.end_node()
        if data.upper().startswith("CDATA["):
            self.node.append(data[len("CDATA[") :])
            self.end_node()


def page_text(html: str) -> str:
    nodes = _Nodes()
    nodes.feed(html)
    nodes.close()
    nodes.end_node()
    return "\n".join(nodes.done)


def _page_text_or_none(html):
    try:
        return None if html is None else page_text(html)
    except Exception:
        return None


@F.pandas_udf(T.StringType())
def _html_text(pages: pd.Series) -> pd.Series:
    return pages.map(_page_text_or_none)


def html_text(html: Column) -> Column:
    """Text of a page; NULL for no page or one the parser rejects."""
    return _html_text(html)
