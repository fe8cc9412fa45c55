"""Rewritten texts: hard negatives and adversarial variants, as column expressions. Each is null
where it doesn't apply or would change nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimark.functions.text import fold, tokens

# Fixed values.
COMPOUNDS = {
    "Kündigungsfrist": "Kündigungsschutzklage",
    "Mietkaution": "Maklerprovision",
    "Krankmeldung": "Urlaubsantrag",
    "Umsatzsteuer": "Einkommensteuer",
    "Widerrufsrecht": "Gewährleistungsrecht",
    "Nettokaltmiete": "Betriebskostenabrechnung",
}
TOGGLES = {
    "besteht ein": "besteht kein",
    "besteht eine": "besteht keine",
    " ist ": " ist nicht ",
    " sind ": " sind nicht ",
    " muss ": " muss nicht ",
    " darf ": " darf nicht ",
    " kann ": " kann nicht ",
    " wird ": " wird nicht ",
}
UNITS = {"Tage": "Monate", "Tagen": "Monaten", "Monate": "Wochen", "Monaten": "Wochen", "Wochen": "Tagen"}
REGIONAL = {"Jänner": "März", "Januar": "März", "Feber": "April", "Februar": "April"}
OUTCOMES = {
    "ausgeschlossen": "möglich",
    "möglich": "ausgeschlossen",
    "unzulässig": "zulässig",
    "zulässig": "unzulässig",
    "unwirksam": "wirksam",
    "wirksam": "unwirksam",
    "wird gewährt": "wird abgelehnt",
    "wird abgelehnt": "wird gewährt",
    "erlaubt": "verboten",
    "verboten": "erlaubt",
}
ENTITIES = {"München": "Hamburg", "Berlin": "Köln", "Bayern": "Sachsen", "Hamburg": "München", "Köln": "Berlin"}
NEGATABLE = ["ist", "sind", "darf", "kann", "muss", "wird", "hat", "war"]
NOT_TRUE = "Es trifft nicht zu, dass "
YEAR = r"\b(1[89]\d{2}|20\d{2})\b"
SECTION_SHIFT, PARAGRAPH_SHIFT, NUMBER_SHIFT = 30, 1, 16
FORMAL = {"Sie": "du", "Ihnen": "dir", "Ihr": "dein"}
INFORMAL = {"du": "Sie", "Du": "Sie", "dein": "Ihr", "Dein": "Ihr", "dich": "Sie", "dir": "Ihnen"}
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}
SENSES = {
    ("golf", "volkswagen"): "Golf bezeichnet hier die Präzisionssportart mit Schläger und Ball, nicht das Automodell.",
    ("golf", "auto"): "Golf bezeichnet hier die Präzisionssportart mit Schläger und Ball, nicht das Automodell.",
    ("bank", "konto"): "Die Bank bezeichnet hier eine Sitzbank im Park, nicht das Geldinstitut.",
    ("schloss",): "Das Schloss bezeichnet hier das Türschloss an einer Tür, nicht das herrschaftliche Gebäude.",
}


def _split_at(x: Column, pattern: str) -> tuple[Column, Column, Column]:
    """What is before, in and after the first match of a pattern with one group."""
    whole = rf"(?s)^(.*?){pattern}(.*)$"
    return tuple(F.regexp_extract(x, whole, i) for i in (1, 2, 3))


def _changed(x: Column, out: Column) -> Column:
    return F.when(fold(out) != fold(x), out)


def _first_swap(x: Column, pairs: dict[str, str], pattern: str) -> Column:
    """The first pair whose pattern is found, its first occurrence replaced. {} is the word."""
    out = None
    for a, b in pairs.items():
        p = pattern.format(a)
        before, _, after = _split_at(x, f"({p})")
        swapped = F.concat(before, F.lit(b), after)
        out = F.when(x.rlike(p), swapped) if out is None else out.when(x.rlike(p), swapped)
    return out


def _shifted(x: Column, pattern: str, by: int, prefix: str = "") -> Column:
    """The first number a pattern's group finds, moved. Up to 18 digits."""
    before, number, after = _split_at(x, pattern)
    moved = (F.try_to_number(number, F.lit("9" * 18)).cast("bigint") + by).cast("string")
    return F.when(x.rlike(f"(?s){pattern}") & (F.length(number) <= 18), F.concat(before, F.lit(prefix), moved, after))


def negation_toggle(x: Column) -> Column:
    swapped = _first_swap(x, TOGGLES, "(?i){}")
    plain = F.concat(F.lit(NOT_TRUE), F.lower(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))
    return F.when(x != "", F.coalesce(_changed(x, swapped), _changed(x, plain)))


def statute_shift(x: Column) -> Column:
    section = _shifted(x, r"§\s*(\d+)", SECTION_SHIFT, "§ ")
    return F.coalesce(_changed(x, section), _changed(x, _shifted(x, r"Abs\.\s*(\d+)", PARAGRAPH_SHIFT, "Abs. ")))


def number_and_unit(x: Column) -> Column:
    moved = F.coalesce(_shifted(x, r"\b(\d+)\b", NUMBER_SHIFT), x)
    return _changed(x, F.coalesce(_first_swap(moved, UNITS, r"\b{}\b"), moved))


def other_compound(x: Column) -> Column:
    return _changed(x, _first_swap(x, COMPOUNDS, "(?iu){}"))


def regional(x: Column) -> Column:
    return _changed(x, _first_swap(x, REGIONAL, "(?iu){}"))


def wrong_sense(x: Column) -> Column:
    toks, out = tokens(x), None
    for words, text in SENSES.items():
        own = F.size(F.array_except(F.array(*map(F.lit, words)), toks)) == 0
        out = F.when(own, text) if out is None else out.when(own, text)
    return _changed(x, out)


def outcome(x: Column) -> Column:
    return _changed(x, _first_swap(x, OUTCOMES, r"(?iU)\b{}\b"))


def eszett(x: Column) -> Column:
    before, _, after = _split_at(x, "(ss)")
    return F.when(x.contains("ß"), F.replace(x, F.lit("ß"), F.lit("ss"))).when(
        x.contains("ss"), F.concat(before, F.lit("ß"), after)
    )


def umlauts(x: Column) -> Column:
    out = x
    for a, b in UMLAUTS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(x.rlike("[äöüÄÖÜ]"), out)


def compound(x: Column) -> Column:
    """The longest word of 12 or more letters, the first of these, cut in the middle."""
    words = F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}_]{12,})"), F.lit(1))
    longest = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    mid = F.floor(F.length(longest) / 2).cast("int")
    at = F.call_function("instr", x, longest)
    cut = F.concat(
        F.substr(x, F.lit(1), at - 1 + mid), F.lit(" "), F.substr(x, at + mid)
    )
    return F.when(F.size(words) > 0, cut)


def register(x: Column) -> Column:
    toks = F.filter(F.split(x, r"\s+"), lambda t: t != "")
    bare = lambda t: F.regexp_replace(t, r"^[,.?!]+|[,.?!]+$", "")
    uses = lambda m: F.exists(toks, lambda t: bare(t).isin(*m))

    def mapped(m: dict[str, str]) -> Column:
        table = F.create_map(*(F.lit(v) for kv in m.items() for v in kv))
        return F.array_join(F.transform(toks, lambda t: F.coalesce(F.try_element_at(table, bare(t)), t)), " ")

    return F.when(uses(FORMAL), mapped(FORMAL)).when(uses(INFORMAL), mapped(INFORMAL))


def paragraph_wording(x: Column) -> Column:
    return F.when(x.contains("§"), F.regexp_replace(x, r"§\s*(\d+)", "Paragraph $1"))


def negated(x: Column) -> Column:
    toks = F.filter(F.split(x, r"\s+"), lambda t: t != "")
    verb = F.transform(toks, lambda t: F.lower(F.regexp_replace(t, r"^[,.?!]+|[,.?!]+$", "")).isin(*NEGATABLE))
    at = F.array_position(verb, F.lit(True)).cast("int")
    out = F.array_join(F.concat(F.slice(toks, F.lit(1), at), F.array(F.lit("nicht")), F.slice(toks, at + 1, F.greatest(F.size(toks), F.lit(1)))), " ")
    return F.when(at > 0, out)


def number_shift(x: Column) -> Column:
    return _shifted(x, r"(\d+)", 1)


def year_shift(x: Column) -> Column:
    return _shifted(x, YEAR, 1)


def section_shift(x: Column) -> Column:
    return _shifted(x, r"§\s*(\d+)", 1, "§ ")


def entity(x: Column) -> Column:
    return _first_swap(x, ENTITIES, "{}")


HARD_NEGATIVES = {
    "compound": other_compound,
    "negation": negation_toggle,
    "legal_ref": statute_shift,
    "dates_numbers": number_and_unit,
    "regional_variant": regional,
    "entity_disambiguation": wrong_sense,
    "outcome_flip": outcome,
}
#: name -> (side, kind, function)
ADVERSARIAL = {
    "ss_eszett": ("query", "paraphrase", eszett),
    "umlaut_ascii": ("query", "paraphrase", umlauts),
    "compound_split": ("query", "paraphrase", compound),
    "register_shift": ("query", "paraphrase", register),
    "legal_ref_wording": ("query", "paraphrase", paragraph_wording),
    "negation": ("document", "distractor", negated),
    "number_shift": ("document", "distractor", number_shift),
    "date_shift": ("document", "distractor", year_shift),
    "legal_ref_wrong": ("document", "distractor", section_shift),
    "entity_swap": ("document", "distractor", entity),
}


def expanded(variants: dict[str, Column]) -> Column:
    """A generator: a row (variant, text) for each variant that applies."""
    each = F.array(*(F.struct(F.lit(n).alias("variant"), c.alias("text")) for n, c in variants.items()))
    return F.inline(F.filter(each, lambda v: v["text"].isNotNull()))
