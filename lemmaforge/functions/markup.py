"""HTML text to node structs: the one place where tags are read in Python."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMED = [
    T.StructField("pre", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
]
NODE = T.StructType(
    [
        NAMED[0],
        T.StructField("end", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("sib", T.IntegerType()),
        *NAMED[1:],
        T.StructField("text", T.StringType()),
    ]
)
TEXT = "#text"

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
# Elements a start tag ends, and the elements that stop the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
SCOPE = frozenset({"table", "td", "th", "caption", "button", "html", "body"})


class NodeReader(HTMLParser):
    """Collects nodes in document order with the extent of each subtree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.children: dict[int, int] = {}
        self.head_done = False

    def add(self, tag: str, attrs: dict[str, str], text: str | None = None) -> dict:
        up = self.open[-1] if self.open else None
        parent = up["pre"] if up else -1
        sib = self.children.get(parent, 0)
        self.children[parent] = sib + 1
        node = {
            "pre": len(self.nodes),
            "end": len(self.nodes),
            "depth": len(self.open),
            "parent": parent,
            "sib": sib,
            "tag": tag,
            "id": attrs.get("id", ""),
            "classes": attrs.get("class", "").split(),
            "attrs": attrs,
            "text": text,
        }
        self.nodes.append(node)
        return node

    def close_last(self) -> None:
        self.open.pop()["end"] = len(self.nodes) - 1

    def close_upto(self, node: dict) -> None:
        while self.open[-1] is not node:
            self.close_last()
        self.close_last()

    def enter(self, tag: str) -> None:
        """Make sure html, head and body stand around what comes next."""
        if not self.open:
            self.open.append(self.add("html", {}))
        inside = {n["tag"] for n in self.open}
        if "body" in inside or "frameset" in inside:
            return
        if tag in HEAD_ONLY and not self.head_done:
            if "head" not in inside:
                self.open.append(self.add("head", {}))
            return
        if "head" in inside:
            if tag == TEXT and self.open[-1]["tag"] != "head":
                return
            self.close_upto(next(n for n in self.open if n["tag"] == "head"))
        elif not self.head_done:
            self.add("head", {})
        self.head_done = True
        self.open.append(self.add("body", {}))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found: dict[str, str] = {}
        for name, value in attrs:
            found.setdefault(name, value or "")
        if tag == "html":
            if not self.open and not self.nodes:
                self.open.append(self.add("html", found))
            return
        if tag == "head":
            if not self.open:
                self.open.append(self.add("html", {}))
            if not self.head_done and all(n["tag"] not in ("head", "body") for n in self.open):
                self.open.append(self.add("head", found))
            return
        if tag == "body":
            if any(n["tag"] == "body" for n in self.open):
                return
            if not self.open:
                self.open.append(self.add("html", {}))
            for node in self.open:
                if node["tag"] == "head":
                    self.close_upto(node)
                    break
            self.head_done = True
            self.open.append(self.add("body", found))
            return
        self.enter(tag)
        if tag in CLOSES_P:
            for node in reversed(self.open):
                if node["tag"] in SCOPE:
                    break
                if node["tag"] == "p":
                    self.close_upto(node)
                    break
        if tag in ENDS:
            ended, stop = ENDS[tag]
            while True:
                hit = None
                for node in reversed(self.open):
                    if node["tag"] in stop or node["tag"] in ("html", "body"):
                        break
                    if node["tag"] in ended:
                        hit = node
                        break
                if hit is None:
                    break
                self.close_upto(hit)
        node = self.add(tag, found)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        for node in reversed(self.open):
            if node["tag"] == tag:
                self.close_upto(node)
                break
        if tag == "head":
            self.head_done = True

    def handle_data(self, data: str) -> None:
        if not data:
            return
        in_body = any(n["tag"] == "body" for n in self.open)
        in_raw = bool(self.open) and self.open[-1]["tag"] in ("title", "style", "script")
        if not in_body and not in_raw and not data.strip():
            return
        if not in_raw:
            self.enter(TEXT)
        last = self.nodes[-1] if self.nodes else None
        if last and last["tag"] == TEXT and last["parent"] == self.open[-1]["pre"] and last["pre"] > self.open[-1]["pre"]:
            last["text"] += data
        else:
            self.add(TEXT, {}, data)

    def finish(self) -> list[dict]:
        self.close()
        if not self.open and not self.nodes:
            self.enter("body")
        while self.open:
            self.close_last()
        return self.nodes


def read_nodes(html: str | None) -> list[dict]:
    reader = NodeReader()
    reader.feed(html or "")
    return reader.finish()


def offsets(sizes: list[int]) -> pa.Array:
    return pa.array(itertools.accumulate(sizes, initial=0), pa.int32())


def lists(values: list[list[str]]) -> pa.Array:
    return pa.ListArray.from_arrays(offsets([len(v) for v in values]), pa.array(itertools.chain(*values), pa.string()))


# letters of markup read before their nodes are packed; texts are never split
SLICE = 1 << 18


def slices(html: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch in runs of about `SLICE` letters, whole texts each."""
    held: list[str | None] = []
    size = 0
    for value in html:
        text = value.as_py()
        held.append(text)
        size += len(text or "")
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


@F.arrow_udf(T.ArrayType(NODE))
def node_structs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Nodes of the texts; only those of a slice are Python objects at a time, however many texts a batch has."""
    for html in batches:
        for texts in slices(html):
            yield packed([read_nodes(text) for text in texts])


def packed(records: list[list[dict]]) -> pa.Array:
    """Nodes of some texts, column by column."""
    nodes = [node for record in records for node in record]
    column = lambda name, kind: pa.array([n[name] for n in nodes], kind)
    attrs = [n["attrs"] for n in nodes]
    named = {
        "pre": column("pre", pa.int32()),
        "tag": column("tag", pa.string()),
        "id": column("id", pa.string()),
        "classes": lists([n["classes"] for n in nodes]),
        "attrs": pa.MapArray.from_arrays(
            offsets([len(a) for a in attrs]),
            pa.array([k for a in attrs for k in a], pa.string()),
            pa.array([v for a in attrs for v in a.values()], pa.string()),
        ),
    }
    columns = {
        "pre": named["pre"],
        "end": column("end", pa.int32()),
        "depth": column("depth", pa.int32()),
        "parent": column("parent", pa.int32()),
        "sib": column("sib", pa.int32()),
        **{k: v for k, v in named.items() if k != "pre"},
        "text": column("text", pa.string()),
    }
    structs = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(offsets([len(r) for r in records]), structs)


class NodeRows:
    """Nodes of one text as rows, for SQL."""

    def eval(self, html: str):
        for node in read_nodes(html):
            yield tuple(node[f.name] for f in NODE.fields)


def register_html_nodes(spark: SparkSession, name: str = "html_nodes") -> None:
    """Makes `html_nodes(text)` a table function of SQL, to be joined by LATERAL; null gives the nodes of no text."""
    spark.udtf.register(name, F.udtf(NodeRows, returnType=NODE))
