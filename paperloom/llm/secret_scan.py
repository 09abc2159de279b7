"""Secrets in texts: three fixed patterns, and character Markov models for what the patterns miss.

Two first-order Markov models over ASCII characters are trained from labelled samples: random strings (label 1, drawn
from the usual alphabets of keys by a seeded generator) and ordinary identifiers (label 0, made of the corpus's own
words: plain, joined in camel, snake and kebab case, with numbers). A run of identifier characters of LEAST or more, or
the part of one that pattern matches leave over, is a secret if its log-likelihood ratio per character passes a
threshold. The threshold is set between the two classes on held-out labelled strings, for short and for long runs apart,
as few characters tell less; shorter runs than LEAST aren't judged, since words and keys are not told apart there.

Spans are (kind, start, end) in code points, end exclusive. Kinds, in order: assign, access, hex, markov.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterable
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import append_columns

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The greedy runs of the contract with their least length: a shorter run never matches, in whole or in part.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What the models judge.
LEAST, LONG = 16, 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Documents whose words make the ordinary identifiers: this many at most, those with the least hash.
TRAIN_ROWS = 400
#: Different words of these documents that reach the driver, at most: those with the least hash. A word has 24 letters at most.
TRAIN_WORDS = 50_000
#: Labelled strings of each class.
TRAIN_STRINGS = 20_000
MASK = "[SECRET]"

Span = tuple[int, int, int]  # kind, start, end


def _has_keyword(text: str) -> bool:
    low = text.lower()
    return any(k in low for k in KEYWORDS)


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns match: leftmost, non-overlapping for each kind, ordered by start, then kind."""
    found: list[Span] = []
    if ("=" in text or ":" in text) and _has_keyword(text):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[1], s[0]))
    return found


class MarkovRatio:
    """Log-likelihood ratio of random strings against identifiers, by character transitions."""

    def __init__(self, table: dict[str, float], threshold: float, short: float | None = None):
        self.table, self.threshold, self.short = table, threshold, threshold if short is None else short

    def score(self, s: str) -> float:
        """Mean log-ratio of the transitions of ``s`` (natural logarithm)."""
        table = self.table
        return sum([table[s[i : i + 2]] for i in range(len(s) - 1)]) / (len(s) - 1)

    def is_secret(self, s: str) -> bool:
        return self.score(s) > (self.threshold if len(s) >= LONG else self.short)

    @classmethod
    def train(cls, ordinary: Iterable[str], secret: Iterable[str]) -> MarkovRatio:
        """Fit both models on three quarters of the labelled strings and set the threshold on the rest."""
        samples = [[s for s in x if len(s) > 1] for x in (ordinary, secret)]
        logs = []
        for group in samples:
            count = {a + b: 0.5 for a in ALPHABET for b in ALPHABET}
            total = dict.fromkeys(ALPHABET, 0.5 * len(ALPHABET))
            for s in group[: len(group) * 3 // 4]:
                for i in range(len(s) - 1):
                    count[s[i : i + 2]] += 1
                    total[s[i]] += 1
            logs.append({p: math.log(n / total[p[0]]) for p, n in count.items()})
        model = cls({p: logs[1][p] - logs[0][p] for p in logs[0]}, 0.0)
        rest = [x[len(x) * 3 // 4 :] for x in samples]
        model.threshold = model._between([[s for s in x if len(s) >= LONG] for x in rest])
        model.short = max(model.threshold, model._between([[s[: LEAST + k % (LONG - LEAST)] for k, s in enumerate(x)] for x in rest]))
        return model

    def _between(self, held_out: list[list[str]]) -> float:
        """Halfway between the largest ordinary score and the first percentile of the secret ones, but never below 0.2."""
        low, high = (sorted(map(self.score, x)) for x in held_out)
        top = low[-1] if low else 0.0
        return max(0.2, (top + max(top, high[len(high) // 100])) / 2) if high else math.inf


def ordinary_words(text: str | None) -> list[str]:
    """The different words of a text outside of pattern matches."""
    text = text or ""
    kept, at = [], 0
    for _, a, b in base_spans(text):
        kept.append(text[at:a])
        at = max(at, b)
    kept.append(text[at:])
    return sorted(set(re.findall(r"[A-Za-z]{2,24}", " ".join(kept))))


def labelled_strings(words: Iterable[str], seed: int = 7, n: int = TRAIN_STRINGS) -> tuple[list[str], list[str]]:
    """(ordinary identifiers, random strings), n of each, from some words and a seeded generator."""
    rng = random.Random(seed)
    words = sorted(words) or ["word", "name", "value", "index", "number", "the", "section", "title"]
    pick = lambda: rng.choice(words)
    ordinary = []
    while len(ordinary) < n:
        parts = [pick() for _ in range(rng.randint(1, 6))]
        kind = rng.randrange(6)
        s = (
            "_".join(x.lower() for x in parts)
            if kind == 0
            else "-".join(x.lower() for x in parts)
            if kind == 1
            else parts[0].lower() + "".join(x.capitalize() for x in parts[1:])
            if kind == 2
            else "/".join(parts)
            if kind == 3
            else "_".join(x.upper() for x in parts)
            if kind == 4
            else "".join(x.lower() for x in parts)
        )
        if rng.random() < 0.2:
            s += rng.choice(["", "_", "-", "/"]) + str(rng.randrange(10 ** rng.randint(1, 8)))
        if len(s) >= LEAST:
            ordinary.append(s)
    alphabets = (
        string.ascii_letters + string.digits,
        string.ascii_letters + string.digits + "+/",
        string.ascii_letters + string.digits + "_-",
        string.ascii_uppercase + string.digits,
        string.ascii_lowercase + string.digits,
        "0123456789ABCDEF",
    )
    secret = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(LONG, 64))) for _ in range(n)]
    return ordinary, secret


def train(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS) -> MarkovRatio:
    """Train the models; ``rows`` bounds the documents whose words make the ordinary class."""
    # By a threshold on the hash, about four times as many rows pass as are wanted, of any number; copies count once.
    span = 1 << 20
    share = min(span, -(-4 * rows * span // max(1, docs.count())))
    sample = docs.select(F.col(f"`{text_col}`").alias("t")).where("t is not null").withColumn("h", F.xxhash64("t"))
    sample = sample.where(F.pmod("h", F.lit(span)) < share).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(rows)
    make = lambda: lambda texts: ([ordinary_words(t) for t in texts],)
    words = append_columns(sample, ["t"], make, [T.StructField("words", T.ArrayType(T.StringType()))], keep=[])
    words = words.select(F.explode("words").alias("word")).distinct().orderBy(F.xxhash64("word"), "word").limit(TRAIN_WORDS)
    return MarkovRatio.train(*labelled_strings(r["word"] for r in words.collect()))


def all_spans(text: str, model: MarkovRatio) -> tuple[list[Span], list[Span]]:
    """(pattern spans, all spans)."""
    base = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for a, b in [(x, y) for _, x, y in base if x < m.end() and m.start() < y] + [(m.end(), m.end())]:
            if a - at >= LEAST and model.is_secret(text[at:a]):
                more.append((3, at, a))
            at = max(at, b)
    return base, sorted(base + more, key=lambda s: (s[1], s[0])) if more else base


def shown(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in spans])


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by a mask; overlapping spans become one. Of an assignment, only the value goes."""
    out, at = [], 0
    for k, a, b in spans:
        if k == 0:
            a = max(a, ASSIGN.match(text, a).start(2))
        a = max(a, at)
        if a < b:
            if not out or a > at or not at:
                out += [text[at:a], MASK]
            at = b
    return "".join(out) + text[at:] if out else text


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)
OUTPUTS = {
    "secrets": SPANS,
    "redacted": T.StringType(),
    "n_assign": T.LongType(),
    "n_access": T.LongType(),
    "n_hex": T.LongType(),
    "n_markov": T.LongType(),
    "base_sha256": T.StringType(),
    "spans": T.StringType(),
}


def scan(
    docs: DataFrame, model: MarkovRatio, text_col: str = "text", outputs: tuple[str, ...] = ("secrets",), keep: list[str] | None = None
) -> DataFrame:
    """Add what is found in whole texts, as named in ``outputs``; map-only.

    A null text counts as empty and has no span (its ``redacted`` stays null). Rows stay as they are, repeated ones too;
    a column named like an output is replaced by it; an empty table gives an empty one.
    """
    parts = model.table, model.threshold, model.short

    def make():
        own = MarkovRatio(*parts)

        def compute(texts: list[str | None]) -> tuple:
            cols: dict[str, list] = {o: [] for o in outputs}
            for t in texts:
                base, spans = all_spans(t or "", own)
                kinds = [k for k, _, _ in spans]
                for o, put in cols.items():
                    if o == "secrets":
                        put.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans])
                    elif o == "redacted":
                        put.append(None if t is None else redacted(t, spans))
                    elif o == "base_sha256":
                        put.append(sha256(shown(base).encode()).hexdigest())
                    elif o == "spans":
                        put.append(shown(spans))
                    else:
                        put.append(kinds.count(KINDS.index(o[2:])))
            return tuple(cols.values())

        return compute

    return append_columns(docs, [text_col], make, [T.StructField(o, OUTPUTS[o]) for o in outputs], keep)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets masked in the text column; all rows and columns stay."""
    found = scan(docs, train(docs, text_col), text_col, ("redacted",))
    return found.select(*[F.col("redacted").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return scan(docs, train(docs), outputs=("n_assign", "n_access", "n_hex", "base_sha256", "spans"), keep=["doc_id"])
