"""Options and errors of the parsers."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


class UnsupportedFileFormatError(ValueError):
    """The document's type can't be determined, or has no parser."""


class UnsafeDocumentError(ValueError):
    """The document passes a size limit or holds what it shouldn't."""


class DecompressedSizeExceededError(ValueError):
    """Packed elements inflate past the limit."""


@dataclass(frozen=True)
class Limits:
    """Sizes that a document may not pass."""

    part_bytes: int = 256 << 20
    package_bytes: int = 1 << 30
    ratio: int = 200
    ratio_bytes: int = 1 << 20
    sheet_cells: int = 5_000_000
    pdf_pages: int = 10_000
    html_depth: int = 200
    csv_field: int = 16 << 20
    inflated_bytes: int = 200 << 20


@dataclass(frozen=True)
class Options:
    """What ``partition`` takes. ``mode``: PERMISSIVE puts a document's error into its row, FAILFAST raises it.

    Accepted without effect: ocr_languages, extract_images_in_pdf, extract_image_block_types, extract_image_block_to_payload,
    extract_image_block_output_dir, hi_res_model_name, model_name, include_header, repeat_table_headers, image_alt_mode.
    """

    encoding: str | None = None
    content_type: str | None = None
    metadata_filename: str | None = None
    metadata_last_modified: str | None = None
    strategy: str = "auto"
    skip_infer_table_types: tuple[str, ...] = ("pdf", "jpg", "png", "heic")
    languages: list[str] | None = None
    detect_language_per_element: bool = False
    language_fallback: object = None
    include_page_breaks: bool | None = None
    include_slide_notes: bool = False
    infer_table_structure: bool = True
    starting_page_number: int = 1
    skip_headers_and_footers: bool = False
    html_parser_version: str = "v1"
    find_subtable: bool = True
    delimiter: str | None = None
    content_source: str = "text/html"
    process_attachments: bool = True
    #: Levels of attachments within attachments that are read; None: all.
    attachment_depth: int | None = None
    paragraph_grouper: object = None
    password: str | None = None
    pdfminer_line_margin: float = 0.5
    unique_element_ids: bool = False
    data_source_metadata: dict | None = None
    chunking_strategy: str | None = None
    chunking: dict = field(default_factory=dict)
    mode: str = "PERMISSIVE"
    limits: Limits = field(default_factory=Limits)


IGNORED = frozenset(
    "ocr_languages extract_images_in_pdf extract_image_block_types extract_image_block_to_payload extract_image_block_output_dir "
    "hi_res_model_name model_name include_header repeat_table_headers image_alt_mode pdf_infer_table_structure".split()
)
CHUNKING = frozenset(
    "max_characters new_after_n_chars overlap overlap_all combine_text_under_n_chars include_orig_elements multipage_sections "
    "skip_table_chunking isolate_table max_tokens new_after_n_tokens tokenizer".split()
)


def make_options(base: Options | None = None, **given) -> Options:
    """Options from keywords; chunking keywords are gathered, unknown ones raise."""
    known = {f.name for f in fields(Options)}
    chunking = {k: v for k, v in given.items() if k in CHUNKING and v is not None}
    own = {k: v for k, v in given.items() if k in known}
    strange = given.keys() - known - CHUNKING - IGNORED
    if strange:
        raise TypeError(f"unknown options: {', '.join(sorted(strange))}")
    out = replace(base or Options(), **own)
    return replace(out, chunking={**out.chunking, **chunking}) if chunking else out
