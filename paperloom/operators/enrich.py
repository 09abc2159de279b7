"""What every parser's elements go through: languages, file metadata, ids, hierarchy.

Here on lists of dictionaries, for one document inside an Arrow pass; ``relational`` has the same steps as expressions over
the element array and over exploded elements.
"""

from __future__ import annotations

import posixpath
import uuid
from hashlib import sha256

from paperloom.functions import row_rules as rules
from paperloom.operators.options import Options

# Which categories an element may be the parent of.
BODY = ("Text", "UncategorizedText", "NarrativeText", "ListItem", "BulletedText", "Table", "FigureCaption", "CheckBox")
CHILDREN = {"Title": frozenset(BODY), "Header": frozenset(("Title", *BODY))}


def set_languages(elements: list[dict], o: Options) -> None:
    if o.languages == [""]:
        return
    whole = " ".join(e["text"] for e in elements if e.get("text"))
    found = rules.detect_languages(whole, o.languages, o.language_fallback)
    alone = found is not None and len(found) == 1 and not o.detect_language_per_element
    for e in elements:
        if e["type"] == "CheckBox" and not alone:
            continue
        codes = list(found) if alone else rules.detect_languages(e.get("text") or "", o.languages, o.language_fallback)
        if codes:
            e["metadata"]["languages"] = codes
        else:
            e["metadata"].pop("languages", None)


def set_file_facts(elements: list[dict], filetype: str | None, o: Options, name: str | None, url: str | None, modified: str | None) -> None:
    """``modified`` fills gaps only, and not in document headers and footers; ``metadata_last_modified`` always holds."""
    shown = o.metadata_filename or name
    facts = {"filetype": filetype, "url": url, "data_source": o.data_source_metadata, "last_modified": o.metadata_last_modified}
    if shown:
        folder, base = posixpath.split(shown)
        facts["filename"] = base
        if folder:
            facts["file_directory"] = folder
    facts = {k: v for k, v in facts.items() if v}
    for e in elements:
        m = e["metadata"]
        if m.get("attached_to_filename"):
            continue
        m |= facts
        if modified and not m.get("last_modified") and not m.get("header_footer_type"):
            m["last_modified"] = modified


def hash_id(e: dict, place: int) -> str:
    """32 hexadecimal digits from file name, text, page and the element's place on the page."""
    m = e["metadata"]
    return sha256(f"{m.get('filename')}{e.get('text') or ''}{m.get('page_number')}{place}".encode("utf-8", "surrogatepass")).hexdigest()[:32]


def set_ids(elements: list[dict], random: bool = False) -> None:
    """Ids, and references to parents by the new ids. Elements of attachments keep theirs."""
    places: dict[int | None, int] = {}
    renamed: dict[str, str] = {}
    own = [e for e in elements if not e["metadata"].get("attached_to_filename")]
    for e in own:
        page = e["metadata"].get("page_number")
        new = str(uuid.uuid4()) if random else hash_id(e, places.get(page, 0))
        places[page] = places.get(page, 0) + 1
        if e.get("element_id"):
            renamed[e["element_id"]] = new
        e["element_id"] = new
    for e in own:
        parent = e["metadata"].get("parent_id")
        if parent in renamed:
            e["metadata"]["parent_id"] = renamed[parent]


def set_hierarchy(elements: list[dict], rules_: dict = CHILDREN) -> None:
    """Parents: the nearest open element of the same category and less depth, or of one that may hold this category."""
    open_: list[tuple[str, int, str]] = []
    for e in elements:
        m = e["metadata"]
        if m.get("parent_id") is not None:
            continue
        kind, depth = e["type"], m.get("category_depth") or 0
        while open_:
            above, level, ident = open_[-1]
            if (level < depth) if above == kind else kind in rules_.get(above, ()):
                m["parent_id"] = ident
                break
            open_.pop()
        open_.append((kind, depth, e["element_id"]))
