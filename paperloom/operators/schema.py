"""The element row. Documents are rows that hold an array of these until they are exploded."""

from __future__ import annotations

LINK = "struct<text:string,url:string,start_index:int>"
COORDINATES = "struct<points:array<struct<x:double,y:double>>,system:string,layout_width:double,layout_height:double>"
DATA_SOURCE = (
    "struct<url:string,version:string,record_locator:string,date_created:string,date_modified:string,date_processed:string,"
    "permissions_data:string>"
)

#: Metadata fields, in order, and their types.
METADATA = {
    "filename": "string",
    "file_directory": "string",
    "filetype": "string",
    "last_modified": "string",
    "url": "string",
    "attached_to_filename": "string",
    "page_number": "int",
    "page_name": "string",
    "category_depth": "int",
    "parent_id": "string",
    "languages": "array<string>",
    "emphasized_text_contents": "array<string>",
    "emphasized_text_tags": "array<string>",
    "link_texts": "array<string>",
    "link_urls": "array<string>",
    "link_start_indexes": "array<int>",
    "links": f"array<{LINK}>",
    "text_as_html": "string",
    "header_footer_type": "string",
    "image_url": "string",
    "image_base64": "string",
    "image_mime_type": "string",
    "image_path": "string",
    "sent_from": "array<string>",
    "sent_to": "array<string>",
    "cc_recipient": "array<string>",
    "bcc_recipient": "array<string>",
    "subject": "string",
    "email_message_id": "string",
    "signature": "string",
    "coordinates": COORDINATES,
    "data_source": DATA_SOURCE,
    "is_continuation": "boolean",
    "table_id": "string",
    "chunk_index": "int",
    "num_carried_over_header_rows": "int",
    "detection_class_prob": "double",
    "extra": "string",
}

METADATA_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in METADATA.items()) + ">"
ELEMENT_TYPE = f"struct<type:string,element_id:string,text:string,checked:boolean,embeddings:array<double>,metadata:{METADATA_TYPE}>"
CHUNK_TYPE = (
    f"struct<type:string,element_id:string,text:string,checked:boolean,embeddings:array<double>,metadata:{METADATA_TYPE},"
    f"orig_elements:array<{ELEMENT_TYPE}>>"
)

# The type strings of serialized elements, by the type that they are read back as. Others are skipped.
_READ_AS = {
    "Title": "Title Section-header Headline Subheadline Field-Name",
    "NarrativeText": "NarrativeText Text Paragraph Abstract Threading Value Link",
    "ListItem": "ListItem BulletedText List-item",
    "Header": "Header Page-header",
    "Footer": "Footer Page-footer Footnote",
    "FigureCaption": "FigureCaption Caption",
    "Image": "Image Figure Picture",
}
READ_AS = {given: kind for kind, names in _READ_AS.items() for given in names.split()} | {
    kind: kind
    for kind in (
        "UncategorizedText CompositeElement Form Table TableChunk Address EmailAddress Formula PageBreak CodeSnippet PageNumber "
        "FormKeysValues DocumentData CheckBox"
    ).split()
}


def element(kind: str, text: str = "", **metadata) -> dict:
    """An element as a dictionary, with the metadata that is set."""
    return {"type": kind, "element_id": None, "text": text, "metadata": {k: v for k, v in metadata.items() if v is not None and v != []}}


def row(e: dict) -> dict:
    """A dictionary with every field of the element type."""
    m = e["metadata"]
    out = {
        "type": e["type"], "element_id": e.get("element_id"), "text": e.get("text"), "checked": e.get("checked"),
        "embeddings": e.get("embeddings"), "metadata": {n: m.get(n) for n in METADATA},
    }
    if "orig_elements" in e:
        out["orig_elements"] = None if e["orig_elements"] is None else [row(x) for x in e["orig_elements"]]
    return out
