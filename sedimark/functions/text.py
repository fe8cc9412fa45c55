"""Text column functions: normal forms, tokens, hashes, splits, classes. Four normal forms are
kept apart, as the operators that use them differ."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MARKERS_DE = [
    "der", "die", "das", "und", "ist", "nicht", "für", "mit", "ein", "eine", "den", "dem", "von",
    "zu", "auf", "wird", "werden",
]
MARKERS_DE_FOLDED = [
    "der", "das", "und", "nicht", "ein", "eine", "ist", "mit", "fuer", "von", "auf", "dem", "den",
    "des", "wird", "betraegt", "oder", "auch", "kein", "keine", "muss", "darf", "bei", "fuers",
    "einen", "einer",
]
ALLOWED_LICENSES = [
    "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "apache-2.0", "mit", "public-domain", "synthetic",
]
NEGATIVE_TYPES = [
    "compound", "negation", "legal_ref", "dates_numbers", "regional_variant",
    "entity_disambiguation", "outcome_flip", "lexical", "random",
]
PII_PATTERNS = {
    "email": r"[\w.+-]+@[\w-]+\.[A-Za-z]{2,}",
    "iban_de": r"\bDE\d{2}[ ]?(?:\d{4}[ ]?){4}\d{2}\b",
    "phone": r"(?<![\w.])(?:\+49|0049|0)[\d][\d /()-]{6,}\d",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
#: White space of any script.
SPACES = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\p{Z}]+"


def _replaced(x: Column, pairs: dict[str, str]) -> Column:
    for a, b in pairs.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def fold(x: Column) -> Column:
    """Lower case, umlauts and ß written out."""
    return _replaced(F.lower(x), {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(fold(x), F.lit(r"([\p{L}\p{N}_§]+)"), F.lit(1))


def tokens_de(x: Column, fold_umlauts: bool = False) -> Column:
    low = _replaced(F.lower(x), {"ß": "ss"})
    if fold_umlauts:
        low = _replaced(low, {"ä": "ae", "ö": "oe", "ü": "ue"})
    return F.regexp_extract_all(low, F.lit("([0-9a-zäöü]+)"), F.lit(1))


def collapsed(x: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def _normalized(form: str):
    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return apply


def _unicode_form(x: Column, form: str) -> Column:
    """Only rows with a code point beyond ASCII go through Python."""
    return F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(
        _normalized(form)(F.when(~x.rlike(r"^\p{ASCII}*$"), x))
    )


def nfc_collapsed(x: Column) -> Column:
    """NFC, white space collapsed, case kept."""
    return F.trim(F.regexp_replace(_unicode_form(x, "NFC"), SPACES, " "))


def leakage_form(x: Column) -> Column:
    """NFKC, lower case, everything but letters, digits and underscore to single spaces."""
    return F.trim(
        F.regexp_replace(F.lower(_unicode_form(x, "NFKC")), r"[^\p{L}\p{N}_]+", " ")
    )


def raw_hash(x: Column, length: int = 16) -> Column:
    """Of a text that is in normal form already."""
    return F.substring(F.sha2(x, 256), 1, length)


def raw_pair(query: Column, document: Column) -> Column:
    return F.concat(F.lit("p"), raw_hash(F.concat(raw_hash(query), F.lit("::"), raw_hash(document))))


def text_hash(x: Column, length: int = 16) -> Column:
    """Of the text in NFC with single spaces, so that spelling of the bytes doesn't count."""
    return raw_hash(nfc_collapsed(x), length)


def pair_id(query: Column, document: Column) -> Column:
    return raw_pair(nfc_collapsed(F.coalesce(query, F.lit(""))), nfc_collapsed(F.coalesce(document, F.lit(""))))


def hash60(x: Column) -> Column:
    """The first 15 hex digits of the MD5 as a number; the same in any engine."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("bigint")


def split_of(key: Column, dev: float = 0.1, test: float = 0.1) -> Column:
    """test, dev or train by the hash of a key, test first."""
    at = F.pmod(hash60(key), F.lit(10000)) / 10000
    return F.when(at < test, "test").when(at < test + dev, "dev").otherwise("train")


def language_hint(x: Column) -> Column:
    low = F.lower(x)
    words = F.split(F.translate(low, ",.", "  "), r"\s+")
    hits = F.size(F.array_intersect(F.array_distinct(words), F.array(*map(F.lit, MARKERS_DE))))
    return F.when(low.rlike("[äöüß]") | (hits >= 2), "de").otherwise("unknown")


def looks_german(x: Column) -> Column:
    marked = F.arrays_overlap(tokens(x), F.array(*map(F.lit, MARKERS_DE_FOLDED)))
    return x.rlike("[äöüßÄÖÜ]") | marked


def query_style(x: Column) -> Column:
    """empty, multi_sentence (2 sentences and 12 words or more), question, keyword (3 words or
    fewer), statement."""
    t = F.trim(F.coalesce(x, F.lit("")))
    n = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    sentences = F.size(F.filter(F.split(t, r"[.!?]+"), lambda s: F.trim(s) != ""))
    return (
        F.when(t == "", "empty")
        .when((sentences >= 2) & (n >= 12), "multi_sentence")
        .when(t.endswith("?"), "question")
        .when(n <= 3, "keyword")
        .otherwise("statement")
    )


def length_bucket(x: Column) -> Column:
    n = F.length(x)
    return F.when(n < 256, "short").when(n < 1024, "medium").otherwise("long")


def margin_bucket(x: Column, cap: int) -> Column:
    """Width-one histogram label, open at both ends; caps differ by operator (5 or 6)."""
    at = F.floor(x)
    label = F.concat(at.cast("string"), F.lit("-"), (at + 1).cast("string"))
    return F.when(x < 0, "<0").when(x >= cap, f">={cap}").otherwise(label)


def unknown(x: Column) -> Column:
    """Null or empty becomes 'unknown'."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown"))


def license_of(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def is_unknown_license(x: Column, allowed: list[str] | None = None) -> Column:
    """Blank or 'unknown'; with an allow-list, also whatever isn't on it."""
    own = license_of(x)
    known = own.isin(*allowed) if allowed else F.lit(True)
    return own.isin("", "unknown") | ~known


def license_is_uncertain(x: Column) -> Column:
    own = license_of(x)
    return (own == "") | own.rlike("uncertain|unknown|verify|tbd|todo|\\?")


def license_origin(x: Column) -> Column:
    return F.when(license_of(x).contains("inherit"), "inherited").otherwise("manifest")


def pii(x: Column, kinds: tuple[str, ...] = tuple(PII_PATTERNS)) -> Column:
    """array of (kind, match), by kind, then in order of the text."""

    def matches(kind: str) -> Column:
        return F.transform(
            F.regexp_extract_all(x, F.lit(PII_PATTERNS[kind]), F.lit(0)),
            lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("match")),
        )

    found = [matches(k) for k in kinds]
    return F.coalesce(F.concat(*found), F.array().cast("array<struct<kind:string,match:string>>"))


def shingles(toks: Column, n: int = 5) -> Column:
    """Distinct n-grams of an array of tokens; fewer tokens: one shingle; none: none."""
    count = F.greatest(F.size(toks) - n + 1, F.lit(1))
    grams = F.transform(
        F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(toks, i, n), " ")
    )
    return F.when(F.size(toks) == 0, F.array().cast("array<string>")).otherwise(
        F.array_distinct(grams)
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def filled(template: Column, name: str, value: Column) -> Column:
    """value for {name} in a template, or the template before it."""
    mark = F.lit("{" + name + "}")
    return F.when(F.instr(template, "{" + name + "}") > 0, F.replace(template, mark, value)).otherwise(
        F.concat(template, value)
    )


def token_class(x: Column, stopwords: list[str]) -> Column:
    """Of a subword token in which U+2581 marks the start of a word: whitespace, punctuation,
    stopword, subword (goes on with a word) or content."""
    raw = F.trim(F.replace(x, F.lit("\u2581"), F.lit(" ")))
    return (
        F.when(raw == "", "whitespace")
        .when(raw.rlike(r"^[^\p{L}\p{N}]+$"), "punctuation")
        .when(F.lower(raw).isin(*stopwords), "stopword")
        .when(~x.startswith("\u2581"), "subword")
        .otherwise("content")
    )


def noncontent_share(tokens_: Column, stopwords: list[str]) -> Column:
    """Share of tokens that aren't content, 4 decimals; 0 without tokens."""
    non = F.size(F.filter(tokens_, lambda t: token_class(t, stopwords) != "content"))
    return F.when(F.size(tokens_) > 0, F.round(non / F.size(tokens_), 4)).otherwise(0.0)
