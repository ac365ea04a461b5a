"""The few per-row Python helpers, each behind an Arrow-batched Spark operator."""

from __future__ import annotations

import json
import re
import sys
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread_small

# workers need not have this package installed: ship these helpers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(T.StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def take(t):
        if not t or "{" not in t:
            return None
        try:
            found, _ = decoder.raw_decode(t, t.index("{"))
        except ValueError:
            return None
        return json.dumps(found)

    return texts.map(take)


# Elements whose text is not shown, and elements without an end tag.
HIDDEN_TAGS = {"script", "style", "noscript", "nav", "footer", "aside", "svg", "template"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Collects what a page shows and says about itself in one pass; nothing is cut."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside: list[str] = []
        self.open: tuple[str, str, list[str]] | None = None  # an element whose text is wanted as a whole, and as what
        self.named: dict[str, str] = {}
        self.whole: dict[str, list[str]] = {"title": [], "heading": [], "data": []}
        self.shown: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        name = next((given[k].strip() for k in ("property", "name", "itemprop") if given.get(k)), "")
        if tag == "meta" and name and given.get("content") is not None:
            self.named.setdefault(name, given["content"].strip())
        if tag not in VOID_TAGS:
            self.inside.append(tag)
            wanted = {"title": "title", "h1": "heading", "h2": "heading"}.get(tag) or ("data" if tag == "script" and given.get("type") == "application/ld+json" else None)
            self.open = (tag, wanted, []) if wanted else self.open

    def handle_endtag(self, tag):
        if self.open and self.open[0] == tag:
            self.whole[self.open[1]].append("".join(self.open[2]).strip())
            self.open = None
        if tag in self.inside:
            del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag):]

    def handle_data(self, data):
        if self.open:
            self.open[2].append(data)
        if not (HIDDEN_TAGS | {"title"}).intersection(self.inside):
            self.shown.append(data)

    def linked_data(self) -> list[str]:
        """The JSON objects of all data blocks; a block that is no JSON says nothing."""
        out = []
        for block in self.whole["data"]:
            try:
                found = json.loads(block)
            except ValueError:
                continue
            out += [json.dumps(x) for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]
        return out


def page_parts(html: str) -> dict:
    """Title, description, metadata, linked data, headings and shown text of a page."""
    page = _Page()
    page.feed(html or "")
    page.close()
    squeezed = (" ".join(re.split(r"[ \t\f\v]+", line)).strip() for line in "\n".join(page.shown).split("\n"))
    return {"title": next(iter(page.whole["title"]), None), "text": "\n".join(filter(None, squeezed)),
            "headings": [h for h in page.whole["heading"] if h], "json_ld": page.linked_data(), "metadata": page.named,
            "description": next((page.named[k] for k in ("description", "og:description", "twitter:description") if page.named.get(k)), None)}


PAGE_FIELDS = "title string, description string, metadata map<string,string>, json_ld array<string>, headings array<string>, text string"


#: Bytes of pages that are parsed before their parts are handed on.
PIECE = 1 << 20


def html_extract(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per page, in pieces of Arrow batches; no shuffle of a large table."""
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), *T.StructType.fromDDL(PAGE_FIELDS).fields])
    kinds = {"metadata": pa.map_(pa.string(), pa.string()), "json_ld": pa.list_(pa.string()), "headings": pa.list_(pa.string())}

    def run(batches):
        for batch in batches:
            ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
                parts = [page_parts(h) for h in batch.column(1).slice(at, to - at).to_pylist()]
                columns = [pa.array([list(p[n].items()) if n == "metadata" else p[n] for p in parts], kinds.get(n, pa.string())) for n in schema.names[1:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *columns], names=schema.names)
                at = to

    return spread_small(pages.select(key, html)).mapInArrow(run, schema)
