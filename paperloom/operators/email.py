"""RFC 822 messages to elements: the body, then the attachments, which go through the whole parser again."""

from __future__ import annotations

import posixpath
from dataclasses import replace
from datetime import timezone
from email import policy
from email.message import EmailMessage
from email.parser import BytesParser
from email.utils import getaddresses, parsedate_to_datetime
from functools import lru_cache

from paperloom.operators.options import Options

SOURCES = ("text/html", "text/plain")
#: Parsed headers that a worker remembers, and the length up to which one is remembered.
HEADERS, HEADER_CHARS = 4096, 1000


class Remembering(policy.EmailPolicy):
    """The default policy, whose headers are parsed once and not at each look: parsed headers don't change."""

    @staticmethod
    @lru_cache(HEADERS)
    def _parsed(name: str, value: str) -> str:
        return policy.default.header_fetch_parse(name, value)

    def header_fetch_parse(self, name, value):
        if hasattr(value, "name") or len(value) > HEADER_CHARS:
            return super().header_fetch_parse(name, value)
        return self._parsed(name, value)


PARSER = BytesParser(policy=Remembering())


def addresses(message: EmailMessage, header: str) -> list[str] | None:
    pairs = getaddresses([str(v) for v in message.get_all(header) or []])
    return [f"{name} <{at}>" if name else at for name, at in pairs if at] or None


def sent_at(message: EmailMessage) -> str | None:
    try:
        when = parsedate_to_datetime(str(message["Date"]))
    except (TypeError, ValueError):
        return None
    return (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat()


def body_of(message: EmailMessage, source: str) -> tuple[str | None, str]:
    """(subtype, text) of the preferred part of the body."""
    part = message.get_body(preferencelist=("plain", "html") if source == "text/plain" else ("html", "plain"))
    if part is None:
        return None, ""
    try:
        text = part.get_content()
    except (LookupError, ValueError):
        text = part.get_payload(decode=True) or b""
    return part.get_content_subtype(), text.decode("utf-8", "replace") if isinstance(text, bytes) else text


def parse_email(data: bytes, o: Options, name: str | None, depth: int = 0) -> list[dict]:
    from paperloom.operators.partition import parse_document

    if o.content_source not in SOURCES:
        raise ValueError(f"content_source is one of {SOURCES}, not {o.content_source!r}")
    message = PARSER.parsebytes(data)
    ident, subject = message.get("Message-ID"), message.get("Subject")
    facts = {
        "sent_from": addresses(message, "From"),
        "sent_to": addresses(message, "To"),
        "cc_recipient": addresses(message, "Cc"),
        "bcc_recipient": addresses(message, "Bcc"),
        "subject": str(subject) if subject else None,
        "email_message_id": str(ident).strip().strip("<>") if ident else None,
        "last_modified": sent_at(message),
    }
    facts = {k: v for k, v in facts.items() if v}
    inner = Options(
        languages=o.languages,
        detect_language_per_element=o.detect_language_per_element,
        language_fallback=o.language_fallback,
        limits=o.limits,
        attachment_depth=o.attachment_depth,
        mode="FAILFAST",
    )
    subtype, body = body_of(message, o.content_source)
    out: list[dict] = []
    if body.strip():
        kind = "text/html" if subtype == "html" else "text/plain"
        out = parse_document(body.encode("utf-8", "surrogatepass"), None, replace(inner, content_type=kind, encoding="utf-8"))
        for e in out:
            e["metadata"] |= facts
    if not o.process_attachments or (o.attachment_depth is not None and depth >= o.attachment_depth):
        return out
    mail = o.metadata_filename or name
    for part in message.iter_attachments():
        called, payload = part.get_filename(), part.get_payload(decode=True)
        if not payload:
            continue
        given = replace(inner, metadata_filename=called, content_type=None if called else part.get_content_type())
        try:
            found = parse_document(payload, called, given, depth=depth + 1)
        except (ValueError, NotImplementedError, ImportError):
            continue
        for e in found:
            e["metadata"]["attached_to_filename"] = posixpath.basename(mail) if mail else called
            if "last_modified" in facts:
                e["metadata"]["last_modified"] = facts["last_modified"]
        out += found
    return out
