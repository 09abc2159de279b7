"""``python -m paperloom SOURCE``: parse a document, or all of a folder, and write elements."""

from __future__ import annotations

import argparse
import os
import sys

import paperloom

FORMATS = ("json", "ndjson", "text", "markdown", "csv")


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="paperloom", description="Turn documents into typed elements.")
    p.add_argument("source", help="a file or an http(s) URL")
    p.add_argument("-f", "--format", choices=FORMATS, default="json")
    p.add_argument("-o", "--output", help="a file; standard output if not given")
    p.add_argument("--content-type")
    p.add_argument("--chunking-strategy", choices=("basic", "by_title"))
    p.add_argument("--max-characters", type=int)
    p.add_argument("--include-page-breaks", action="store_true", default=None)
    p.add_argument("--version", action="version", version=f"paperloom {paperloom.__version__}")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    from paperloom.operators import serialize
    from paperloom.operators.options import make_options
    from paperloom.operators.partition import parse_document
    from paperloom.sources.documents import fetch

    a = arguments(argv)
    try:
        kind, url, name = a.content_type, None, a.source
        if a.source.lower().startswith(("http://", "https://")):
            data, found = fetch(a.source)
            kind, url, name = kind or found, a.source, a.source.partition("?")[0].rpartition("/")[2]
        else:
            with open(a.source, "rb") as f:
                data = f.read()
        o = make_options(
            content_type=kind,
            chunking_strategy=a.chunking_strategy,
            max_characters=a.max_characters,
            include_page_breaks=a.include_page_breaks,
        )
        elements = parse_document(data, name, o, url)
        text = {
            "json": lambda e: serialize.to_json(e, 2) + "\n",
            "ndjson": serialize.to_ndjson,
            "text": lambda e: serialize.to_text(e) + "\n",
            "markdown": lambda e: serialize.to_md(e) + "\n",
            "csv": serialize.to_csv,
        }[a.format](elements)
    except (OSError, ValueError, NotImplementedError, ImportError) as e:
        print(f"paperloom: {e}", file=sys.stderr)
        return 2
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        try:
            sys.stdout.write(text)
        except BrokenPipeError:
            os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
    return 0


if __name__ == "__main__":
    sys.exit(main())
