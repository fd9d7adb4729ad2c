"""Selectors over web pages as steps on a table of nodes.

Pages become rows: elements with the interval that they span in their page's order, and pieces
of text with their place in it. One element contains another if its interval does, so a
descendant's step is a running maximum over the page's order, a child's step a look at the rows
that share a parent, and neither joins a page with itself. Selectors are data: any number of them
go through the same steps at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .pages import Selectors, parsed

_NOT_LAST = ":not(:last-child)"
#: Rows that are handed over at a time, about.
_AT_ONCE = 10_000


def _rows(page, html: str) -> Iterator[tuple]:
    """Of a page's elements and pieces of text: page, begin, end, parent (the parent's begin), last, tag, classes, text."""
    at, todo = 0, [(iter(parsed(html).parts), None, None)]
    # an element's row comes at its end, when its interval is known
    while todo:
        parts, node, begin = todo[-1]
        for part in parts:
            at += 1
            if isinstance(part, str):
                yield page, at, None, begin, None, None, None, part
            else:
                todo.append((iter(part.parts), part, at))
                break
        else:
            todo.pop()
            at += 1
            if node is not None:
                yield page, begin, at, todo[-1][2], node.parent.children[-1] is node, node.tag, list(node.classes), None


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The rows of all pages that there are; a page that can't be parsed has none. id_col tells pages apart."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["page", "begin", "end", "parent", "last", "tag", "classes", "text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(0).type
            rows: list[tuple] = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows += list(_rows(page, html.as_py()))
                except Exception:  # noqa: BLE001  one bad page mustn't end the others
                    continue
                if len(rows) >= _AT_ONCE:
                    yield made(rows, of)
                    rows = []
            if rows:
                yield made(rows, of)

    def made(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [of, *types], strict=True)], names)

    there = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("page"), F.col(html_col).alias("html"))
    return there.mapInArrow(run, f"page {kind}, begin bigint, end bigint, parent bigint, last boolean, tag string, classes array<string>, text string")


def _steps(selectors: dict[str, str]) -> list[tuple[str, int, int, str, bool, bool]]:
    """name, step (from 1), how many steps, key (`tag` or `.class`), whether it has to be a child of the step before, whether it mustn't be a last child."""
    out = []
    for name, selector in selectors.items():
        words = selector.replace(">", " > ").split()
        own = [w for w in words if w != ">"]
        child = [k > 0 and words[k - 1] == ">" for k, w in enumerate(words) if w != ">"]
        out += [(name, k, len(own), w.removesuffix(_NOT_LAST), c, w.endswith(_NOT_LAST)) for k, (w, c) in enumerate(zip(own, child, strict=True), 1)]
    return out


def select(rows: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """page, name, begin, end of the elements that the selectors choose.

    selectors: by name, of `tag`, `.class`, each perhaps with `:not(:last-child)`, in descent
    (`article p`) or as children (`article > p`). Their table is what is broadcast.
    """
    steps = _steps(selectors)
    table = rows.sparkSession.createDataFrame(steps, "name string, step int, steps int, key string, child boolean, inner boolean")
    keyed = rows.where(F.col("tag").isNotNull()).withColumn("key", F.explode(F.array_distinct(F.concat(F.array("tag"), F.transform("classes", lambda c: F.concat(F.lit("."), c))))))
    own = keyed.join(F.broadcast(table), "key").where(~F.col("inner") | ~F.col("last")).select("page", "name", "begin", "end", "parent", "step", "steps", "child", (F.col("step") == 1).alias("ok"))
    # of an element that matches several steps the later ones come first, so that it doesn't contain itself
    before = Window.partitionBy("page", "name").orderBy("begin", F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    for k in range(2, max((s[1] for s in steps), default=1) + 1):
        held = F.col("ok") & (F.col("step") == k - 1)
        # intervals nest, so one that begins before and is open still contains this element
        inside = F.max(F.when(held, F.col("end"))).over(before) > F.col("begin")
        family = Window.partitionBy("page", "name", F.when(F.col("step") == k, F.col("parent")).otherwise(F.col("begin")))
        of_parent = F.max(held).over(family)
        own = own.withColumn("ok", F.when(F.col("step") == k, F.coalesce(F.when(F.col("child"), of_parent).otherwise(inside), F.lit(False))).otherwise(F.col("ok")))
    return own.where("ok AND step = steps").select("page", "name", "begin", "end")


def texts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """page, name and the texts of the chosen elements in the page's order."""
    pieces = rows.where(F.col("text").isNotNull()).select("page", F.col("begin").alias("at"), "text")
    inside = chosen.join(pieces, (chosen["page"] == pieces["page"]) & (F.col("at") > F.col("begin")) & (F.col("at") < F.col("end")), "left").select(chosen["page"], "name", "begin", "at", "text")
    ordered = lambda place, what: F.transform(F.array_sort(F.collect_list(F.struct(place, what))), lambda x: x[what])
    each = inside.groupBy("page", "name", "begin").agg(F.array_join(ordered("at", "text"), "").alias("text"))
    return each.groupBy("page", "name").agg(ordered("begin", "text").alias("texts"))


def extract(pages: DataFrame, selectors: Selectors | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """As `pages.extract`, by steps on nodes: pages without their HTML, with title, byline, text and error."""
    s = selectors or Selectors()
    rows = nodes(pages, id_col, html_col)
    chosen = select(rows, {"title": s.title, "byline": s.byline, "text": s.text + _NOT_LAST * s.skip_last})
    found = texts(rows, chosen).groupBy("page").agg(*[F.first(F.when(F.col("name") == n, F.col("texts")), ignorenulls=True).alias(f"_{n}") for n in ("title", "byline", "text")])
    of = lambda n: F.coalesce(f"_{n}", F.array().cast("array<string>"))
    there = F.col(html_col).isNotNull()
    title, byline = (F.when(there, T.trim(F.array_join(of(n), ""))) for n in ("title", "byline"))
    body = F.when(there, F.array_join(F.transform(of("text"), T.trim), "\n"))
    done = pages.join(found, F.col(id_col) == F.col("page"), "left")
    return done.select(*[c for c in pages.columns if c != html_col], title.alias("title"), byline.alias("byline"), body.alias("text"), F.when(~there, "no page").alias("error"))
