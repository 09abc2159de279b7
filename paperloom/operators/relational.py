"""Enrichment as expressions: over the element array of a document's row, and over exploded elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import text_rules
from paperloom.functions.cleaners import bind
from paperloom.operators.enrich import CHILDREN


def hash_id(filename: Column, text: Column, page: Column, place: Column) -> Column:
    parts = [F.coalesce(filename.cast("string"), F.lit("None")), F.coalesce(text, F.lit("")), F.coalesce(page.cast("string"), F.lit("None"))]
    return F.substring(F.sha2(F.concat(*parts, place.cast("string")), 256), 1, 32)


def document_languages(elements: Column, languages: list[str] | None = None) -> Column:
    """Codes of the whole document's text, from array<struct<text, ...>>."""
    return text_rules.detect_languages(F.array_join(F.filter(F.transform(elements, lambda e: e["text"]), lambda t: t != ""), " "), languages)


def may_hold(above: Column, kind: Column) -> Column:
    out = F.lit(False)
    for parent, kinds in CHILDREN.items():
        out = F.when(above == parent, kind.isin(sorted(kinds))).otherwise(out)
    return out


def parents(elements: Column) -> Column:
    """array<string> of parent ids from array<struct<type, depth, element_id>>: a fold whose state is the open elements.

    Of the open elements, all above the nearest fitting one are closed; where none fits, all are.
    """
    kind = "struct<type:string,depth:int,element_id:string>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("open"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, e: Column) -> Column:
        fits = lambda o: F.when(o["type"] == e["type"], o["depth"] < e["depth"]).otherwise(may_hold(o["type"], e["type"]))
        places = F.transform(state["open"], lambda o, k: F.when(fits(o), k + 1).otherwise(0))
        last = F.coalesce(F.array_max(places), F.lit(0))
        kept = F.slice(state["open"], F.lit(1), last)
        parent = F.when(last > 0, F.element_at(state["open"], F.when(last > 0, last).otherwise(1))["element_id"])
        own = F.struct(e["type"].alias("type"), e["depth"].cast("int").alias("depth"), e["element_id"].alias("element_id"))
        return F.struct(
            F.concat(kept, F.array(own)).alias("open"),
            F.concat(state["found"], F.array(parent)).alias("found"),
        )

    return F.aggregate(elements, start, step, lambda s: s["found"])


def enrich_column(docs: DataFrame, column: str = "elements", filename: Column | None = None) -> DataFrame:
    """array<struct<type, text>> -> with element_id, parent_id and languages, for documents without pages and depths."""
    name = filename if filename is not None else F.lit(None).cast("string")
    with_ids = F.transform(
        F.col(column),
        lambda e, k: F.struct(
            e["type"].alias("type"), F.lit(0).alias("depth"), hash_id(name, e["text"], F.lit(None), k).alias("element_id"), e["text"].alias("text")
        ),
    )
    docs = docs.withColumn(column, with_ids)
    # What lambdas below refer to is bound, so that it isn't computed again for each element.
    kinds = F.transform(F.col(column), lambda e: F.struct(e["type"].alias("type"), e["depth"].alias("depth"), e["element_id"].alias("element_id")))

    def merged(codes: Column) -> Column:
        return F.zip_with(
            F.col(column),
            parents(kinds),
            lambda e, parent: F.struct(
                e["type"].alias("type"),
                e["text"].alias("text"),
                e["element_id"].alias("element_id"),
                parent.alias("parent_id"),
                F.coalesce(codes, text_rules.detect_languages(e["text"])).alias("languages"),
            ),
        )

    return docs.withColumn(column, bind(document_languages(F.col(column)), merged))


def assign_ids(elements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Exploded elements (doc, pos, text, and optionally filename, page_number, element_id, parent_id) with new ids.

    Places count from 0 on each page, null being a page; references to parents follow. A window over (document, page) and
    an equi-join, so a document's elements must fit the sort of one task, not its memory.
    """
    have = elements.columns
    optional = {c: F.col(c) if c in have else F.lit(None).cast("string") for c in ("filename", "page_number", "element_id", "parent_id")}
    place = F.row_number().over(Window.partitionBy(doc, optional["page_number"]).orderBy("pos")) - 1
    new = elements.withColumn("__new", hash_id(optional["filename"], F.col("text"), optional["page_number"], place))
    if "parent_id" not in have or "element_id" not in have:
        return new.withColumn("element_id", F.col("__new")).drop("__new")
    names = new.select(F.col(doc).alias("__doc"), F.col("element_id").alias("__old"), F.col("__new").alias("__name")).where("__old is not null")
    joined = new.join(names, (F.col(doc) == F.col("__doc")) & (F.col("parent_id") == F.col("__old")), "left")
    return joined.withColumns({"element_id": F.col("__new"), "parent_id": F.coalesce("__name", "parent_id")}).select(*have)


def convert_coordinates(points: Column, old: tuple[str, float, float], new: tuple[str, float, float]) -> Column:
    """Points between systems (name, width, height): PixelSpace's y runs down, the others' up; RelativeCoordinates are 1 x 1."""
    (a, w0, h0), (b, w1, h1) = (s if s[0] != "RelativeCoordinates" else (s[0], 1.0, 1.0) for s in (old, new))
    flip = (a == "PixelSpace") != (b == "PixelSpace")
    scaled = lambda p: (p["x"] / w0 * w1, p["y"] / h0 * h1)
    return F.transform(
        points, lambda p: F.struct(scaled(p)[0].alias("x"), (F.lit(float(h1)) - scaled(p)[1] if flip else scaled(p)[1]).alias("y"))
    )
