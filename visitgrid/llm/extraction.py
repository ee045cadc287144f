"""Main text of web pages by a linear-chain conditional random field.

A page becomes its leaf blocks in page order (``dom``). The steps of its chain are the blocks; their
features are the tags and the class and id words of all elements around them, their own element,
and what their text looks like: length, link share, ending, signs, capitals, digits, the words of
short labels, and the words and the part that are closest. Edges differ by whether two blocks stand in
one container, and are named alike there. The field (``crf``) is
trained on labelled pages: by default the layouts of ``layouts``, a fixed number of them, or any
pages marked in the same way. Its weights go to every task, which decodes page by page.

Defined cases: a null, empty or blank page has the empty text, as has one without main text.
Pages of any length are parsed whole, in linear time. Repeated rows get equal results. Empty tables
give empty results. Other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitgrid.llm import crf
from visitgrid.llm.dom import Block, leaf_blocks
from visitgrid.llm.layouts import labelled_pages

#: Up to this number of words a block is a label, whose words are features.
LABEL_WORDS = 4
#: Kinds of edges: to another container, in one container, in one container and named alike.
EDGES = 3
LENGTHS = (1, 2, 4, 8, 16, 32, 64, 128)


def text_features(b: Block) -> list[str]:
    words = b.text.split(" ")
    n = len(words)
    last = b.text.rstrip("\"'”’»)")[-1:]
    out = ["bias", f"is:{b.element}", f"long:{sum(n >= x for x in LENGTHS)}",
           f"linked:{'none' if b.linked == 0 else 'some' if b.linked < 0.5 else 'most'}",
           f"end:{'stop' if last in tuple('.!?…。！？') else 'other'}"]
    if b.linked >= 0.5:
        out.append(f"linked:{b.element}")
    if "©" in b.text or "copyright" in b.text[:200].lower():
        out.append("sign:copyright")
    if any(x in b.text for x in ("|", "·", "»", "›", "•")):
        out.append("sign:bar")
    if n > 2 and 2 * sum(w[0].isupper() for w in words) > n:
        out.append("capitals")
    if 5 * sum(map(str.isdigit, b.text)) > len(b.text):
        out.append("digits")
    if n <= LABEL_WORDS:
        out += {f"says:{w.lower().strip('.,:;!?')}" for w in words}
    return out


def chain_of(blocks: list[Block]):
    """(features, kind of edge) of every block; the first edge is not used."""
    out, before = [], None
    for b in blocks:
        kind = 0 if before is None or b.container != before.container else 1 if b.near != before.near else 2
        out.append(([*text_features(b), *b.around, *b.near], kind))
        before = b
    return out


def trained(pages) -> crf.Field:
    """The field that labelled pages give."""
    parsed = [leaf_blocks(p) for p in pages]
    return crf.fit([chain_of(p) for p in parsed], [[int(b.main) for b in p] for p in parsed], kinds=EDGES)


@cache
def default_field() -> crf.Field:
    return trained(labelled_pages())


def main_text(page, field: crf.Field, known: frozenset | None = None) -> str:
    """The main text of a page: its main blocks, two line ends between them."""
    if not isinstance(page, str):
        return ""
    blocks = leaf_blocks(page, field.weights.keys() if known is None else known)
    labels = crf.decode(field, chain_of(blocks))
    return "\n\n".join(b.text for b, y in zip(blocks, labels) if y)


def extracted(pages: DataFrame, field: crf.Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    field = field or default_field()
    known = frozenset(field.weights)
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = dict(pages.dtypes)["page_id"]

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), field, known) for x in batch.column("html")]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                   pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
