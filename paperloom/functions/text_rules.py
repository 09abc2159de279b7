"""The text rules as column expressions: predicates, sentence and word splitting, languages.

All of it stays in the JVM: regular expressions, higher-order functions and set membership.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import lexicon as lx
from paperloom.functions.cleaners import BULLET, WS, bind, clean_bullets, remove_punctuation, strip
from paperloom.functions.row_rules import setting

EMAIL = r"\A[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\z"
PHONE = r"(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\b\d{3}[\s.-])?\b\d{3}[\s.-]\d{4}\b"
CITY_ZIP = rf"(?i)\A[A-Za-z][A-Za-z .'\-]*,\s*(?:{lx.US_STATES}|{lx.US_STATE_CODES}),?\s+\d{{5}}(?:-\d{{4}})?\z"
NUMBERED = rf"\A{WS}*\d{{1,3}}(?:\.\d{{1,3}})*[.)]{WS}+[^{lx.SPACES}]"
LETTER_OR_DIGIT = r"[\p{L}\p{N}_]"
WORD = rf"{LETTER_OR_DIGIT}+(?:['’-]{LETTER_OR_DIGIT}+)*|[^\p{{L}}\p{{N}}_{lx.SPACES}]"
_CLOSERS = "\"')\\]’”"
_SHORT = "|".join(a.replace(".", r"\.") for a in lx.ABBREVIATIONS)
#: Where a sentence ends: behind stops and closers, unless they are one period after an abbreviation or a single letter.
SENTENCE_GAP = (
    rf"(?<=[.!?][{_CLOSERS}]{{0,6}})(?<!(?:\A|{WS})[(\"']{{0,4}}(?:(?i:{_SHORT})|\p{{L}})\.[{_CLOSERS}]{{0,6}})"
    rf"{WS}+(?=[^{lx.SPACES}])(?!\p{{Ll}})"
)


def is_bulleted_text(c: Column) -> Column:
    return c.rlike(BULLET)


def is_email_address(c: Column) -> Column:
    return strip(c).rlike(EMAIL)


def is_us_city_state_zip(c: Column) -> Column:
    return strip(c).rlike(CITY_ZIP)


def contains_us_phone_number(c: Column) -> Column:
    return c.rlike(PHONE)


def is_possible_numbered_list(c: Column) -> Column:
    return c.rlike(NUMBERED)


def sent_tokenize(c: Column) -> Column:
    """An array of sentences."""
    return F.filter(F.split(strip(c), SENTENCE_GAP), lambda s: s != "")


def word_tokenize(c: Column) -> Column:
    """An array of words with their inner apostrophes and hyphens, and of single symbols."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def _n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(remove_punctuation(c), f"{WS}+"), lambda w: w != ""))


def sentence_count(c: Column, min_length: int | None = None) -> Column:
    sentences = sent_tokenize(c)
    return F.size(sentences if not min_length else F.filter(sentences, lambda s: _n_words(s) >= min_length))


def alpha_ratio(c: Column) -> Column:
    """Letters among characters that are not white space; null if there are none."""
    seen = F.length(F.regexp_replace(c, WS, ""))
    return F.when(seen > 0, F.regexp_count(c, F.lit(r"\p{L}")) / seen)


def under_non_alpha_ratio(c: Column, threshold: float = 0.5) -> Column:
    return F.coalesce(alpha_ratio(c) < threshold, F.lit(False))


def _all_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


def capital_share(c: Column) -> Column:
    """Capitalized words among those of letters only; null if there are none."""
    capital = r"\A(?:[\p{Lu}\p{Lt}][^\p{Lu}\p{Lt}]*|[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*)\z"
    words = F.filter(word_tokenize(c), lambda w: w.rlike(r"\A\p{L}+\z"))
    return bind(words, lambda a: F.when(F.size(a) > 0, F.size(F.filter(a, lambda w: w.rlike(capital))) / F.size(a)))


def exceeds_cap_ratio(c: Column, threshold: float = 0.5) -> Column:
    return (sentence_count(c, 3) <= 1) & (_all_upper(c) | F.coalesce(capital_share(c) > threshold, F.lit(True)))


def contains_verb(c: Column) -> Column:
    """True on an auxiliary, an irregular past, an -ed or -ing form, or a common verb in a verb's position."""
    tokens = F.transform(F.filter(word_tokenize(c), lambda t: t.rlike(r"\A[\p{L}\p{N}]")), F.lower)
    base = lx.base_verbs()
    content = lambda w: w.rlike(r"\A\p{L}+\z") & ~w.isin(lx.DETERMINERS + lx.PREPOSITIONS)
    adjective = rf"(?:{'|'.join(lx.ADJECTIVE_ENDINGS)})\z"

    def verb(x: Column) -> Column:
        i, token, before, after = x["i"], x["token"], x["before"], x["after"]
        size = F.length(token)
        always = token.isin(lx.ALWAYS_VERBS)
        past = (size > 4) & token.endswith("ed") & ~token.isin(lx.NOT_VERBS_ED)
        going = (size > 5) & token.endswith("ing") & ~token.isin(lx.NOT_VERBS_ING)
        plural = content(before) & (F.length(before) > 3) & before.rlike(r"[^s]s\z")
        bare = token.isin(base) & (
            before.isin(lx.SUBJECTS + lx.BARE_CUES)
            | ((i == 0) & after.isin(lx.IMPERATIVE_NEXT))
            | (plural & after.isin(lx.IMPERATIVE_NEXT + lx.PREPOSITIONS))
        )
        stem = lambda k: F.substring(token, F.lit(1), size - k)
        inflected = (
            (token.endswith("ies") & (size > 4) & F.concat(stem(3), F.lit("y")).isin(base))
            | (token.endswith("es") & (size > 3) & stem(2).isin(base))
            | (token.rlike(r"[^s]s\z") & (size > 2) & stem(1).isin(base))
        ) & (before.isin(lx.SUBJECTS) | (content(before) & ~before.rlike(adjective)))
        return always | past | going | bare | inflected

    def placed(t: Column) -> Column:
        """Each token with its neighbours."""
        beside = lambda k: F.coalesce(F.get(t, k), F.lit(""))
        return F.transform(
            t,
            lambda x, i: F.struct(i.alias("i"), x.alias("token"), beside(i - 1).alias("before"), beside(i + 1).alias("after")),
        )

    return F.exists(bind(tokens, placed), verb)


def contains_english_word(c: Column) -> Column:
    common = sorted({*lx.ALWAYS_VERBS, *lx.base_verbs(), *lx.DETERMINERS, *lx.PREPOSITIONS, *lx.SUBJECTS, *lx.COMMON_WORDS})
    words = F.transform(word_tokenize(F.lower(c)), lambda t: F.regexp_replace(t, "[^a-z]", ""))
    return F.exists(words, lambda w: (F.length(w) > 1) & w.isin(common))


def _numeric(c: Column) -> Column:
    return c.rlike(r"\A\p{N}+\z")


def is_possible_narrative_text(
    c: Column,
    cap_threshold: float = 0.5,
    non_alpha_threshold: float = 0.5,
    languages: Sequence[str] = ("eng",),
    language_checks: bool = False,
) -> Column:
    ok = (c != "") & ~_numeric(c) & ~exceeds_cap_ratio(c, setting("NARRATIVE_TEXT_CAP_THRESHOLD", cap_threshold))
    ok &= ~under_non_alpha_ratio(c, setting("NARRATIVE_TEXT_NON_ALPHA_THRESHOLD", non_alpha_threshold))
    if "eng" in languages:
        if setting("LANGUAGE_CHECKS", language_checks):
            ok &= contains_english_word(c)
        ok &= (sentence_count(c, 3) > 1) | contains_verb(c)
    return ok


def is_possible_title(
    c: Column,
    sentence_min_length: int = 5,
    title_max_word_length: int = 12,
    non_alpha_threshold: float = 0.5,
    languages: Sequence[str] = ("eng",),
    language_checks: bool = False,
) -> Column:
    shouted = _all_upper(c) & c.rlike(rf"[^\p{{L}}\p{{N}}_{lx.SPACES}]\z")
    ok = (c != "") & ~shouted & ~c.endswith(",") & ~_numeric(c)
    ok &= F.size(F.split(c, " ")) <= setting("TITLE_MAX_WORD_LENGTH", title_max_word_length)
    ok &= ~under_non_alpha_ratio(c, setting("TITLE_NON_ALPHA_THRESHOLD", non_alpha_threshold))
    if "eng" in languages and setting("LANGUAGE_CHECKS", language_checks):
        ok &= contains_english_word(c)
    return ok & (sentence_count(c, sentence_min_length) <= 1)


def classify(c: Column) -> Column:
    """struct<type, text> of a paragraph of plain text."""
    kind = (
        F.when(is_bulleted_text(c), "ListItem")
        .when(is_email_address(c), "EmailAddress")
        .when(is_us_city_state_zip(c), "Address")
        .when(is_possible_numbered_list(c), "ListItem")
        .when(is_possible_narrative_text(c), "NarrativeText")
        .when(is_possible_title(c), "Title")
        .otherwise("UncategorizedText")
    )
    return F.struct(kind.alias("type"), F.when(is_bulleted_text(c), clean_bullets(c)).otherwise(c).alias("text"))


def detect_language(c: Column) -> Column:
    """Three-letter code, or null: by script where it outweighs Latin, else by frequent words, earlier languages first."""
    head = F.substring(c, 1, 20_000)
    patterns = {code: rf"[\p{{Is{script}}}&&\p{{L}}]" for script, code in lx.SCRIPTS if code not in ("jpn", "zho")}
    patterns |= {"kana": r"[\p{IsHiragana}\p{IsKatakana}]", "han": r"\p{IsHan}", "latin": r"\p{IsLatin}"}
    other = head.rlike(r"[\p{L}&&[^\p{IsLatin}]]")
    counts = F.struct(*[F.regexp_count(head, F.lit(p)).alias(n) for n, p in patterns.items()])

    def by_script(n: Column) -> Column:
        of = {
            code: F.when(n["kana"] > 0, n["kana"] + n["han"]).otherwise(0)
            if code == "jpn"
            else F.when(n["kana"] > 0, 0).otherwise(n["han"])
            if code == "zho"
            else n[code]
            for _, code in lx.SCRIPTS
        }
        ranked = F.array_max(F.array(*[F.struct(v.alias("n"), F.lit(-k).alias("k"), F.lit(code).alias("c")) for k, (code, v) in enumerate(of.items())]))
        return F.when((ranked["n"] > 0) & (ranked["n"] >= n["latin"]), ranked["c"])

    script = F.when(other, bind(counts, by_script))
    words = F.regexp_extract_all(F.lower(head), F.lit(r"\p{L}+"), F.lit(0))

    def by_words(w: Column) -> Column:
        def hit(known: list[str]) -> Column:
            return F.size(F.filter(w, lambda x: x.isin(known)))

        hits = [F.struct(hit(p.split()).alias("n"), F.lit(-k).alias("k"), F.lit(code).alias("c")) for k, (code, p) in enumerate(lx.PROFILES.items())]
        return bind(F.array_max(F.array(*hits)), lambda x: F.when(x["n"] > 0, x["c"]))

    return bind(
        script, lambda s: F.when((s == "rus") & c.rlike(f"[{lx.UKRAINIAN}]"), F.lit("ukr")).otherwise(F.coalesce(s, bind(words, by_words)))
    )


def detect_languages(c: Column, languages: Sequence[str] | None = None) -> Column:
    """array<string> or null, as ``row_rules.detect_languages``."""
    if languages is not None and (not languages or not languages[0]):
        return F.lit(None).cast("array<string>")
    if languages is None or "auto" in languages:
        found = detect_language(c)
        codes = bind(found, lambda x: F.when(x.isNotNull(), F.array(x)))
    else:
        alias = lx.alias_of()
        codes = F.array(*[F.lit(x) for x in dict.fromkeys(alias.get(x.lower(), x.lower()[:3]) for x in languages)])
    short = c.rlike(r"\A[\x00-\x7F]*\z") & (F.size(F.filter(F.split(c, f"{WS}+"), lambda w: w != "")) < 5)
    return F.when(strip(c) == "", None).when(short, F.array(F.lit("eng"))).otherwise(codes)


