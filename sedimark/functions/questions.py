"""Generated questions: slots of a passage, templates over them, prompts, and rows.

A template is a Column over slot columns and is null where a slot is missing; a passage is
expanded by one `inline`, without a shuffle or a Python worker.

Edge cases. Null or empty passages have no slot and no question. Ties of a slot: the first word in
the text, entities in the order of their list. Repeated passages are expanded each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions import text as tx
from sedimark.functions import variants as vr

# Words, entities, templates and prompts of the generator.
STOPWORDS = [
    "Der", "Die", "Das", "Ein", "Eine", "Es", "In", "Im", "Am", "An", "Auf", "Und", "Wie", "Was", "Wann", "Wer", "Für", "Mit", "Von", "Zu", "Bei",
]
ENTITIES = ["München", "Berlin", "Hamburg", "Köln", "Bayern", "Sachsen", "Hessen"]
#: template -> (method, family, style, text); names in braces are slots, all of which must be there.
TEMPLATES = {
    "factual": ("factual_question", "germanquad", "factual", "Was versteht man unter {topic}?"),
    "definition": ("definition_question", "germanquad", "factual", "Was bedeutet {topic}?"),
    "wer": ("wer_question", "germanquad", "factual", "Wer oder was ist {topic}?"),
    "date_number": ("date_number_query", "germanquad", "date_number", "{date_number}"),
    "entity_disambig": ("entity_disambiguation_query", "germanquad", "entity", "Bezieht sich {entity} hier auf die Stadt oder das Bundesland?"),
    "keyword": ("keyword_search", "web", "keyword", "{topic} {keyword}"),
    "web_fragment": ("web_fragment_query", "web", "keyword", "{topic} {keyword} erklärung"),
    "web_typo": ("web_typo_query", "web", "keyword", "{typo} info"),
    "faq": ("faq_query", "faq", "faq", "Häufige Frage: Wie kann ich {topic} beantragen?"),
    "faq_problem": ("faq_problem_query", "faq", "faq", "Was tun, wenn {topic} nicht funktioniert?"),
    "faq_lost": ("faq_lost_query", "faq", "faq", "Ich habe {topic} vergessen – was nun?"),
    "colloquial": ("colloquial_query", "faq", "colloquial", "Wie funktioniert das mit {topic} eigentlich?"),
    "formal_admin": ("formal_administrative", "admin", "admin", "Welche Voraussetzungen gelten für {topic}?"),
    "admin_unterlagen": ("admin_unterlagen_query", "admin", "admin", "Welche Unterlagen brauche ich für {topic}?"),
    "admin_frist": ("admin_frist_query", "admin", "admin", "Frist für {topic}"),
    "admin_antrag_online": ("admin_antrag_online_query", "admin", "admin", "Antrag {topic} online stellen"),
    "legal_admin": ("legal_admin_query", "admin", "legal", "{legal}"),
    "legal_ref_absatz": ("legal_ref_absatz_query", "admin", "legal", "{legal_ref} Absatz Bedeutung"),
    "crosslingual_en": ("crosslingual_en_query", "cross_lingual_de_en", "cross_lingual", "What is {topic}?"),
    "negated": ("negated_query", "negation", "negation", "Wann gilt {topic} nicht?"),
    "negation_distractor": ("negation_distractor_query", "negation", "negation", "Was hat nichts mit {topic} zu tun?"),
}
DATE_QUESTION = "Was geschah im Jahr {year} im Zusammenhang mit {about}?"
NUMBER_QUESTION = "Welche Bedeutung hat die Zahl {number} bei {about}?"
LEGAL_QUESTION, LEGAL_TOPIC_QUESTION = "Was regelt {legal_ref}?", "Welche gesetzliche Regelung gilt für {topic}?"
DEFAULT_FAMILIES = ["admin", "cross_lingual_de_en", "faq", "germanquad", "web"]
#: style -> instruction, question of a dry run.
STYLES = {
    "germanquad_fact": ("Stelle eine konkrete Faktenfrage zu einer im Abschnitt genannten Tatsache.", "Welche Tatsache nennt der Abschnitt zu {title}?"),
    "definition": ("Frage nach der Bedeutung oder Definition eines im Abschnitt erklärten Begriffs.", "Was bedeutet {title} laut dem Abschnitt?"),
    "how_to": ("Frage nach dem Vorgehen oder den Schritten, die der Abschnitt beschreibt.", "Wie geht man laut dem Abschnitt bei {title} vor?"),
    "comparison": ("Frage nach einem Unterschied oder Vergleich, der aus dem Abschnitt hervorgeht.", "Worin unterscheidet sich {title} von Verwandtem im Abschnitt?"),
    "reason_why": ("Frage nach dem Grund oder der Ursache für eine im Abschnitt genannte Aussage.", "Warum gilt die Aussage zu {title} im Abschnitt?"),
    "evidence_support": ("Frage danach, welche Belege der Abschnitt für eine Aussage liefert.", "Welche Belege nennt der Abschnitt für {title}?"),
    "long_doc_locating": (
        "Stelle eine Frage, deren Antwort nur in einem bestimmten Teil des Abschnitts steht (Lokalisierungsfrage).",
        "An welcher Stelle behandelt der Abschnitt {title}?",
    ),
    "ambiguous_needs_context": (
        "Stelle eine kurze, mehrdeutige Frage, die ohne Titel/Kontext nicht eindeutig ist, aber mit dem Abschnitt beantwortbar bleibt.",
        "Worum geht es bei {title}?",
    ),
    "short_web_search": ("Formuliere eine sehr kurze Web-Suchanfrage (Stichworte) zum Abschnitt.", "{words}"),
    "german_stress": (
        "Formuliere eine Frage mit deutscher Härte: Negation, Datum, Kompositum oder Entitäts-Disambiguierung.",
        "Welche Frist gilt NICHT für {title} laut Abschnitt?",
    ),
}
PROMPT = (
    "Du bist Experte für deutsche Informationssuche und RAG-Qualität.\n"
    "Lies den folgenden Textabschnitt und formuliere GENAU EINE deutschsprachige Frage, die AUSSCHLIESSLICH mit diesem Abschnitt beantwortet werden kann. "
    "Die Frage darf NICHT aus Allgemeinwissen beantwortbar sein und muss den Abschnitt zwingend benötigen.\n"
    "Frage-Stil: {style} — {instruction}\n\nTitel: {title}\nTextabschnitt:\n\"\"\"\n{document}\n\"\"\"\n\n"
    "Antworte AUSSCHLIESSLICH mit einem einzigen JSON-Objekt in genau diesem Format (keine Erklärung, kein Markdown):\n"
    '{{"query": "<deine Frage auf Deutsch>", "query_style": "{style}", "answerable_only_from_passage": true, "answerable_without_passage": false}}\n'
    'Setze "answerable_without_passage" auf true, falls die Frage auch ohne den Abschnitt beantwortbar wäre — solche Fragen werden verworfen.'
)
_NOUN = r"\b([A-ZÄÖÜ][\wäöüß]{3,})"


def _nouns(x: Column) -> Column:
    return F.filter(F.regexp_extract_all(x, F.lit("(?U)" + _NOUN + r"\b"), F.lit(1)), lambda w: ~w.isin(*STOPWORDS))


def topic(x: Column) -> Column:
    """The longest capitalised word that isn't a stop word, the first in a tie."""
    best = F.aggregate(_nouns(x), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.nullif(best, F.lit(""))


def keyword(x: Column) -> Column:
    """The first other one."""
    return F.get(F.filter(_nouns(x), lambda w: w != topic(x)), F.lit(0))


def _first(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 0), F.lit(""))


def number(x: Column) -> Column:
    return _first(x, r"(?U)\b\d+\b")


def year(x: Column) -> Column:
    return _first(x, r"(?U)\b(?:1[89]\d{2}|20\d{2})\b")


def legal_ref(x: Column) -> Column:
    return _first(x, r"§\s*\d+")


def entity(x: Column) -> Column:
    """The first of the list that the text contains."""
    return F.coalesce(*(F.when(x.contains(e), F.lit(e)) for e in ENTITIES))


def _filled(template: str, slots: dict[str, Column]) -> Column:
    """The template with its slots; null if one is null."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), slots[name]]
    return F.concat(*parts, F.lit(rest))


def slots(x: Column) -> dict[str, Column]:
    """Slots of a text, with those that are made of others."""
    own = {"topic": topic(x), "keyword": keyword(x), "number": number(x), "year": year(x), "legal_ref": legal_ref(x), "entity": entity(x)}
    own["about"] = F.coalesce(own["topic"], F.lit("diesem Thema"))
    own["typo"] = F.coalesce(vr.eszett(own["topic"]), vr.umlauts(own["topic"]))
    own["date_number"] = F.coalesce(_filled(DATE_QUESTION, own), _filled(NUMBER_QUESTION, own))
    own["legal"] = F.coalesce(_filled(LEGAL_QUESTION, own), _filled(LEGAL_TOPIC_QUESTION, own))
    return own


def generated(
    passages: DataFrame, families: list[str] | None = None, styles: list[str] | None = None, most: int | None = None, least_chars: int = 0, most_chars: int | None = None
) -> DataFrame:
    """doc_id, template, family, style, method, query, document, positive, query_id, pair_hash of
    passages (doc_id, document): a row per template that applies. Families: all but negation,
    whose questions are distractors, by default. most: so many rows a passage, families in turn."""
    text = tx.nfc_collapsed(F.coalesce("document", F.lit("")))
    rows = passages.select("doc_id", text.alias("document")).filter((F.col("document") != "") & (F.length("document") >= least_chars))
    if most_chars is not None:
        rows = rows.withColumn("document", F.substring("document", 1, most_chars))
    made = slots(F.col("document"))
    rows = rows.select("*", F.struct(*(c.alias(n) for n, c in made.items())).alias("s"))
    own = {n: F.col("s")[n] for n in made}
    chosen = [(t, v) for t, v in TEMPLATES.items() if v[1] in (families or DEFAULT_FAMILIES) and (styles is None or v[2] in styles)]
    each = [
        F.struct(F.lit(i).alias("nth"), F.lit(t).alias("template"), F.lit(f).alias("family"), F.lit(st).alias("style"), F.lit(m).alias("method"), _filled(q, own).alias("query"))
        for i, (t, (m, f, st, q)) in enumerate(chosen)
    ]
    found = F.filter(F.array(*each), lambda q: q["query"].isNotNull())
    if most is not None:
        found = _in_turn(found, most)
    out = rows.select("doc_id", "document", F.inline(found)).withColumn("query", tx.nfc_collapsed(F.col("query")))
    return out.select(
        "doc_id", "template", "family", "style", "method", "query", "document", (F.col("family") != "negation").alias("positive"),
        F.concat(F.lit("q"), tx.raw_hash(F.col("query"))).alias("query_id"), tx.raw_pair(F.col("query"), F.col("document")).alias("pair_hash"),
    )


def _in_turn(found: Column, most: int) -> Column:
    """The first `most`, one of each family in turn, families as they come."""
    turn = lambda q: F.size(F.filter(found, lambda o: (o["family"] == q["family"]) & (o["nth"] < q["nth"])))
    start = lambda q: F.array_min(F.transform(F.filter(found, lambda o: o["family"] == q["family"]), lambda o: o["nth"]))
    keyed = F.transform(found, lambda q: F.struct(turn(q).alias("turn"), start(q).alias("start"), q.alias("q")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda k: k["q"])


def _title(df: DataFrame) -> Column:
    return F.nullif(F.col("title"), F.lit("")) if "title" in df.columns else F.lit(None).cast("string")


def first_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != ""), 1, n), " ")


def prompts(passages: DataFrame, styles: list[str] | None = None) -> DataFrame:
    """prompt_id, source_passage_id, query_style, prompt of passages (source_passage_id, document,
    title): one per style."""
    each = []
    for s in styles or STYLES:
        if s not in STYLES:
            raise ValueError(f"unknown style: {s}")
        values = {"style": F.lit(s), "instruction": F.lit(STYLES[s][0]), "title": F.coalesce(_title(passages), F.lit("(kein Titel)")), "document": F.coalesce("document", F.lit(""))}
        head, _, spec = PROMPT.partition("{{")
        spec, _, tail = spec.partition("}}")
        prompt = F.concat(_filled(head, values), F.lit("{"), _filled(spec, values), F.lit("}"), F.lit(tail))
        each.append(F.struct(F.lit(s).alias("query_style"), prompt.alias("prompt")))
    rows = passages.select("source_passage_id", F.inline(F.array(*each)))
    return rows.select(F.substring(F.md5(F.concat_ws("\u001f", "source_passage_id", "query_style")), 1, 16).alias("prompt_id"), "*")


def _row(df: DataFrame, query: Column, style: Column, method: Column, answerable: Column | None = None) -> list[Column]:
    source = F.nullif(F.col("source_id"), F.lit("")) if "source_id" in df.columns else F.lit(None).cast("string")
    return [
        F.col("source_passage_id"), query.alias("query"), F.col("document"), style.alias("query_style"), method.alias("generation_method"), F.lit(True).alias("synthetic_query"),
        F.col("license"), F.coalesce(source, "source_passage_id").alias("source_id"), F.col("domain"), F.lit(True).alias("must_teacher_validate"),
        (answerable if answerable is not None else F.lit(None).cast("boolean")).alias("answerable_without_passage"),
    ]


def dry_run(passages: DataFrame, styles: list[str] | None = None) -> DataFrame:
    """A templated question of each style for each passage."""
    words = first_words(F.col("document"), 4)
    title = F.coalesce(_title(passages), F.nullif(words, F.lit("")), F.lit("dieses Thema"))
    values = {"title": title, "words": F.coalesce(F.nullif(words, F.lit("")), title)}
    each = [F.struct(F.lit(s).alias("_style"), _filled(STYLES[s][1], values).alias("_query")) for s in styles or STYLES]
    rows = passages.select("*", F.inline(F.array(*each)))
    return rows.select(*_row(passages, F.col("_query"), F.col("_style"), F.lit("dry_run_templates")))


def from_answers(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """Rows of a model's answers (source_passage_id, query, query_style, answerable_without_passage,
    model), with status: kept; rejected, as answerable without the passage; or an error:
    unknown_passage, empty_query, unknown_style. What is trusted comes from the passage."""
    p = passages.withColumn("_there", F.lit(True))
    a = answers.select("source_passage_id", F.trim("query").alias("_query"), F.col("query_style").alias("_style"), F.col("answerable_without_passage").alias("_free"), F.col("model").alias("_model"))
    rows = a.join(p, "source_passage_id", "left")
    status = (
        F.when(F.col("_there").isNull(), "unknown_passage").when(F.coalesce("_query", F.lit("")) == "", "empty_query")
        .when(~F.coalesce(F.col("_style").isin(*STYLES), F.lit(False)), "unknown_style").when(F.coalesce("_free", F.lit(False)), "rejected").otherwise("kept")
    )
    method = F.coalesce(F.nullif(F.col("_model"), F.lit("")), F.lit("local_llm_jsonl"))
    return rows.select(*_row(passages, F.col("_query"), F.col("_style"), method, F.col("_free")), status.alias("status"))


def style_report(rows: DataFrame) -> DataFrame:
    """query_style, n, for all styles, and two examples of each."""
    every = rows.sparkSession.createDataFrame([(s,) for s in STYLES], "query_style string")
    one = F.struct("source_passage_id", "query")
    own = rows.groupBy("query_style").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("a"), F.max(one).alias("b"))
    examples = F.array_distinct(F.array_compact(F.array("a", "b")))
    return every.join(own, "query_style", "left").select("query_style", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.transform(examples, lambda e: e["query"]), F.array().cast("array<string>")).alias("examples"))
