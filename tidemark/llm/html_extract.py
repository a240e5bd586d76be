"""Main text of web pages by wrapper induction.

Pages of one host share a template. A page's element tree becomes a skeleton: its
block elements with their texts' lengths and hashes, neighbours of one form (the paragraphs of an
article, the entries of a menu) folded into one node that may repeat. Skeletons of a host are aligned by
simple tree matching (the largest set of matching nodes that keeps order and
ancestry) and merged into the host's wrapper. A node whose text is the same on every page is
template, a node whose text varies is a slot. The wrapper's content root is the
article or main element that holds most of the text in slots outside of links and
boilerplate, or else the deepest node that holds all of it. A page is aligned with its host's wrapper once more,
and its main text is what is under its content root, without boilerplate elements
and template nodes.

Scale. Wrappers can be merged in any order (ties between alignments may fall differently, which moves which of two
equal nodes a slot is, not what varies), so each task folds the pages it reads, host by host,
and only wrappers are shuffled: a host with a third of all pages is a few rows
for each task. They meet in salted groups first. Rules go back to pages by a join of
plain exchanges, which adaptive execution can split. Nodes that differ in
label only by digits are alike, and a wrapper keeps at most ``NODES`` nodes for a parent (the
commonest) and folds the others into one, which bounds rules but never drops a page's text.

Cases. Null html is empty and has an empty text. A null or hostless address is a
host of its own. A host with fewer than ``MIN_PAGES`` different pages has no
template nodes: copies of one page do not make their article a template. A page
without its wrapper's root is read by its own tree alone. Equal rows are pages each. Other columns are
ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.html_tree import Node, blocks, parse
from tidemark.llm.shared import materialize

MIN_PAGES = 8
#: Share of the slots' text that an article or main element has to hold to be the content root.
ROOT_SHARE = 0.5
NODES = 200
#: Share of matching nodes that makes neighbours alike, and children that are folded by label if more.
ALIKE = 0.7
WIDE = 60
SALTS = 16
#: Hosts that a task holds before it passes its wrappers on.
HOSTS = 2000


class Skel:
    """A node of a skeleton or wrapper.

    ``pages`` have it; ``chars`` and ``links`` sum its text outside and inside links;
    ``value`` is the hash of its text, None if that varies; ``many``: it repeats on a page.
    ``nodes``: the elements it stands for, on a page's skeleton.
    """

    __slots__ = ("chars", "children", "junk", "label", "links", "many", "nodes", "pages", "value")

    def __init__(self, label, junk=False, pages=1, chars=0, links=0, value=0, many=False, children=None, nodes=None):
        self.nodes = nodes or []
        self.label, self.junk, self.pages, self.chars, self.links = label, junk, pages, chars, links
        self.value, self.many, self.children = value, many, children or []

    def dump(self) -> list:
        return [self.label, self.junk, self.pages, self.chars, self.links, self.value, self.many, [c.dump() for c in self.children]]

    @staticmethod
    def load(x: list) -> Skel:
        return Skel(*x[:7], [Skel.load(c) for c in x[7]])


def matching(a: Skel, b: Skel) -> int:
    """Simple tree matching: the most nodes that match in order, 0 if the roots differ."""
    if a.label != b.label:
        return 0
    return 1 + _table(a.children, b.children)[-1][-1]


def _table(left: list[Skel], right: list[Skel]) -> list[list[int]]:
    m = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, a in enumerate(left, 1):
        for j, b in enumerate(right, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + matching(a, b))
    return m


def _aligned(left: list[Skel], right: list[Skel]) -> list[tuple[Skel | None, Skel | None]]:
    if [x.label for x in left] == [x.label for x in right]:
        return list(zip(left, right, strict=True))
    m = _table(left, right)
    i, j, out = len(left), len(right), []
    while i and j:
        if m[i][j] == m[i - 1][j]:
            i -= 1
            out.append((left[i], None))
        elif m[i][j] == m[i][j - 1]:
            j -= 1
            out.append((None, right[j]))
        else:
            i, j = i - 1, j - 1
            out.append((left[i], right[j]))
    out += [(left[k], None) for k in range(i - 1, -1, -1)] + [(None, right[k]) for k in range(j - 1, -1, -1)]
    return out[::-1]


def merge(a: Skel, b: Skel, fold: bool = False) -> Skel:
    """Two aligned trees as one; ``fold``: they are neighbours on one page, and ``a`` is used up."""
    if fold:
        a.nodes += b.nodes
    children = []
    for x, y in _aligned(a.children, b.children):
        children.append(merge(x, y, fold) if x and y else x or y)
    if len(children) > NODES:
        children = _common(children)
    return Skel(
        a.label, a.junk and b.junk, max(a.pages, b.pages) if fold else a.pages + b.pages, a.chars + b.chars, a.links + b.links,
        (xxhash.xxh3_64_intdigest(f"{a.value} {b.value}") >> 1) if fold else a.value if a.value == b.value else None,
        fold or a.many or b.many, children, a.nodes if fold else None,
    )


def _common(children: list[Skel]) -> list[Skel]:
    """The ``NODES`` commonest in their order, the rest as one node that matches nothing but counts as a slot.

    None of the rest can be template: that takes nine pages in ten.
    """
    order = sorted(range(len(children)), key=lambda k: (not children[k].label, -children[k].pages, k))
    rest = [children[k] for k in order[NODES:]]
    total = lambda x: (x.chars + sum(total(c)[0] for c in x.children if not c.junk), x.links + sum(total(c)[1] for c in x.children if not c.junk))
    sums = [total(x) for x in rest if not x.junk]
    folded = Skel("", False, max(x.pages for x in rest), sum(c for c, _ in sums), sum(n for _, n in sums), None, True)
    return [children[k] for k in sorted(order[:NODES])] + [folded]


def _size(x: Skel) -> int:
    return 1 + sum(map(_size, x.children))


def _alike(a: Skel, b: Skel) -> bool:
    """Of one form: leaves, or most of their nodes match."""
    if a.label != b.label or bool(a.children) != bool(b.children):
        return False
    return not a.children or 2 * matching(a, b) >= ALIKE * (_size(a) + _size(b))


def _folded(children: list[Skel]) -> list[Skel]:
    """Children beyond ``WIDE`` folded by label alone, wherever they stand."""
    by_label: dict[str, Skel] = {}
    for c in children:
        by_label[c.label] = merge(by_label[c.label], c, fold=True) if c.label in by_label else c
    return list(by_label.values())


def skeleton(node: Node, junk: bool = False) -> Skel:
    chars = links = 0
    texts, children = [], []
    junk = junk or node.junk
    for x in node.parts:
        if isinstance(x, tuple):
            n = len(x[0].strip())
            if n:
                links, chars = links + n * x[1], chars + n * (not x[1])
                texts.append(x[0].strip())
            continue
        child = skeleton(x, junk)
        if children and _alike(children[-1], child):
            children[-1] = merge(children[-1], child, fold=True)
        else:
            children.append(child)
    if len(children) > WIDE:
        children = _folded(children)
    return Skel(node.label, junk, 1, chars, links, xxhash.xxh3_64_intdigest("\n".join(texts)) >> 1, False, children, [node])


def host_of(url: str | None) -> str:
    m = re.match(r"(?i)\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url or "")
    return m[1].lower() if m else ""


# A wrapper: its tree and the least hashes of its different pages.


def _least(hashes: list[int]) -> list[int]:
    return sorted(set(hashes))[:MIN_PAGES]


def _joined(a: tuple[Skel, list[int]], b: tuple[Skel, list[int]]) -> tuple[Skel, list[int]]:
    return merge(a[0], b[0]), _least(a[1] + b[1])


def _mass(node: Skel, template: bool) -> int:
    """Characters of slots below a node, outside of links and boilerplate."""
    if node.junk:
        return 0
    own = 0 if template and node.value is not None else max(0, node.chars - node.links)
    return own + sum(_mass(c, template) for c in node.children)


def rules(wrapper: Skel, pages: list[int]) -> dict:
    """The wrapper's labels with its template nodes marked, and the content root's place.

    ``tree``: label, template or not, children; ``root``: a child's number at each level.
    """
    template = len(pages) >= MIN_PAGES
    total = _mass(wrapper, template)
    if not total:
        template = False
        total = _mass(wrapper, False)
    path, node, named = [], wrapper, None
    whole = path, node
    while total and node.children:
        k = max(range(len(node.children)), key=lambda k: _mass(node.children[k], template))
        best = node.children[k]
        if best.many or _mass(best, template) < ROOT_SHARE * total or re.match(r"(p|pre|td|li|h[1-6])\b", best.label):
            break
        path, node = [*path, k], best
        if _mass(best, template) == total:
            whole = path, node
        if re.match(r"(article|main)\b|.*@main\b", best.label):
            named = list(path), best
            if best.label.startswith("article"):
                break
    path, node = named or whole

    def marked(x: Skel, inside: bool) -> list:
        same = x.value is not None and not x.many and not x.children and x.chars + x.links > 0
        constant = template and inside and same and x.pages >= 0.9 * node.pages
        return [x.label, constant, [marked(c, inside or x is node) for c in x.children]]

    return {"root": path, "tree": marked(wrapper, False)}


def _loaded(x: list) -> Skel:
    return Skel(x[0], value=x[1], children=[_loaded(c) for c in x[2]])


def _template(wrapper: Skel, page: Skel) -> set[int]:
    """The identities of a page's elements that are template nodes of its wrapper."""
    found = set()
    for w, p in _aligned(wrapper.children, page.children):
        if w and p:
            found |= {id(n) for n in p.nodes} if w.value else _template(w, p)
    return found


def _inside(node: Node, tag: str) -> list[Node]:
    """The outermost elements of that name that are not in boilerplate."""
    out = []
    for x in node.parts:
        if isinstance(x, Node) and not x.junk:
            out += [x] if x.tag == tag else _inside(x, tag)
    return out


def extract(html: str | None, rule: dict | None = None) -> str:
    """A page's main text, by its host's rules or by its own tree."""
    tree = parse(html or "")
    if rule:
        wrapper, page = rule["tree"] if isinstance(rule["tree"], Skel) else _loaded(rule["tree"]), skeleton(tree)
        for k in rule["root"]:
            pairs = _aligned(wrapper.children, page.children) if page else []
            wrapper = wrapper.children[k]
            page = next((p for w, p in pairs if w is wrapper), None)
        if page:
            drop = _template(wrapper, page)
            lines = blocks(page.nodes, lambda node, path: id(node) in drop)
            if lines:
                return "\n".join(lines)
    for tag in ("article", "main"):
        lines = blocks(_inside(tree, tag))
        if lines:
            return "\n".join(lines)
    return "\n".join(blocks([tree]))


# Spark.


def _row(host: str, salt: int, w: tuple[Skel, list[int]]) -> tuple[str, int, str]:
    return host, salt, json.dumps([w[0].dump(), w[1]])


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    host, salt, wrapper = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(host), pa.array(salt, pa.int32()), pa.array(wrapper)], ["host", "salt", "wrapper"])


def _wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts of a task's pages."""
    held: dict[str, tuple[Skel, list[int]]] = {}
    salt = 0
    for b in batches:
        for url, html in zip(b.column(0), b.column(1), strict=True):
            page = html.as_py() or ""
            host = host_of(url.as_py())
            one = skeleton(parse(page)), [xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass")) >> 1]
            salt = one[1][0] % SALTS
            held[host] = _joined(held[host], one) if host in held else one
            if len(held) >= HOSTS:
                yield _batch([_row(h, salt, w) for h, w in held.items()])
                held = {}
    if held:
        yield _batch([_row(h, salt, w) for h, w in held.items()])


def _met(final: bool):
    """Wrappers of one host (and salt) made one; rows come ordered by host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        held: tuple[Skel, list[int]] | None = None

        def done() -> tuple[str, int, str]:
            return (now[0], 0, json.dumps(rules(*held))) if final else _row(*now, held)

        for b in batches:
            rows = []
            for host, salt, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = host, 0 if final else salt
                tree, pages = json.loads(text)
                one = Skel.load(tree), pages
                if key == now:
                    held = _joined(held, one)
                    continue
                if now is not None:
                    rows.append(done())
                now, held = key, one
            if rows:
                yield _batch(rows)
        if now is not None:
            yield _batch([done()])

    return run


def induce(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, rules as JSON) of each host of ``pages``."""
    schema = "host string, salt int, wrapper string"
    parts = pages.select(F.col(url).cast("string").alias("url"), F.col(html).alias("html")).mapInArrow(_wrapped, schema)
    some = parts.repartition("host", "salt").sortWithinPartitions("host", "salt").mapInArrow(_met(False), schema)
    whole = some.repartition("host").sortWithinPartitions("host").mapInArrow(_met(True), schema)
    return whole.select("host", F.col("wrapper").alias("rules"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for b in batches:
        texts = []
        for html, rule in zip(b.column(2), b.column(3), strict=True):
            rule = rule.as_py()
            if rule is not None and rule not in known:
                if len(known) > HOSTS:
                    known.clear()
                known[rule] = json.loads(rule)
                known[rule]["tree"] = _loaded(known[rule]["tree"])
            texts.append(extract(html.as_py(), known.get(rule)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Each page's id, address, main text and its length in code points."""
    found = materialize(induce(pages, url, html), "wrappers")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("of_host"))
    ruled = rows.join(found, F.col("of_host") == F.col("host"), "left").select("id", "url", "html", "rules")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string"
    return ruled.mapInArrow(_extracted, schema).select(
        F.col("id").alias(page_id), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars")
    )
