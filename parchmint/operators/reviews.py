"""Product reviews: prompts built and answers cleaned; the model's call is not here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmint.functions.spans import let, nonblank, strip
from parchmint.functions.text import collapsed

from .gates import as_text

# Where sentences end, bounds of requests.
SENTENCE = r"(?<=[.!?])\s+"
RATING, SENTENCES, QUESTIONS = (1, 5, 3), (4, 6, 5), (1, 10, 5)
OPEN, CLOSE = "<<<PRODUCT_DATA_BEGIN>>>", "<<<PRODUCT_DATA_END>>>"
FORGED = r"(?i)<<<\s*PRODUCT_DATA_(?:BEGIN|END)\s*>>>"
TONES = {
    "balanced": "Even-handed. Note what works and what does not.",
    "positive": "Favourable, while staying believable and specific.",
    "critical": "Candid about shortcomings, but fair rather than hostile.",
    "enthusiastic": "Warm and energetic, without becoming advertising copy.",
    "professional": "Measured and factual, as in a trade publication.",
}
OWN_WORDS = "Written by AI from answers supplied by the reviewer. The experience described comes from the reviewer, the wording from the model."
MADE_UP = "AI-generated sample content. No verified customer experience was supplied, so this must not be presented as a genuine customer review."
NO_OUTPUT = "LLM_INVALID_OUTPUT"


def sentences(text: Column) -> Column:
    return F.filter(F.split(strip(text), SENTENCE), nonblank)


def sentence_count(text: Column) -> Column:
    return F.size(sentences(text))


def first_sentences(text: Column, n: int) -> Column:
    """text stripped, or its first n sentences joined by one space."""
    own = sentences(text)
    return F.when(F.size(own) <= n, strip(text)).otherwise(F.array_join(F.slice(own, 1, n), " "))


def resolve_rating(requested: Column, answered: Column) -> Column:
    """The requested rating, else the answered one within bounds, else the middle."""
    low, high, middle = RATING
    said = answered.try_cast("int")
    return F.coalesce(requested.try_cast("int"), F.when(said.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), said))), F.lit(middle))


def parse_answer(text: Column) -> Column:
    """A JSON object without its fence as a map, null where it is none."""
    body = strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```[A-Za-z]*\s*", ""), r"\s*```\z", ""))
    return F.when(body.startswith("{"), F.from_json(body, "map<string,string>", {"mode": "PERMISSIVE"}))


def questions(raw: Column, count: int) -> Column:
    """Clean questions up to count; a missing list counts as empty."""
    return F.slice(F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), collapsed), lambda q: q.isNotNull()), 1, count)


def unmarked(text: Column) -> Column:
    """A text without forged marks; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), FORGED, "[REDACTED_MARKER]")


def _block(lines: Column) -> Column:
    return F.concat_ws("\n", F.lit(OPEN), F.array_join(lines, "\n"), F.lit(CLOSE))


def _told(name: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), unmarked(value)))


def prompt(product: Column, answers: Column, tone: Column, sentences: Column, language: Column, category: Column | None = None, description: Column | None = None, attributes: Column | None = None, rating: Column | None = None) -> Column:
    """The request to a writer: product and answers (array<struct<question, answer>>) between marks, then what to write.

    Forged marks in any part are replaced first. attributes is a map<string,string>, told in its order.
    """
    none = F.lit(None).cast("string")
    pairs = F.map_entries(F.coalesce(attributes, F.create_map().cast("map<string,string>"))) if attributes is not None else F.array().cast("array<struct<key:string,value:string>>")
    head = F.array_compact(F.array(F.concat(F.lit("Product: "), unmarked(product)), _told("Category", none if category is None else category), _told("Description", none if description is None else description)))
    more = F.transform(pairs, lambda e: F.concat(unmarked(e["key"]), F.lit(": "), unmarked(e["value"])))
    numbered = F.transform(answers, lambda a, i: F.concat((i + 1).cast("string"), F.lit(". Q: "), unmarked(a["question"]), F.lit("\n   A: "), unmarked(a["answer"])))
    own = F.when(F.size(answers) > 0, F.concat(F.array(F.lit(""), F.lit("The customer's own answers:")), numbered)).otherwise(F.array().cast("array<string>"))
    orders = F.array_compact(F.array(
        F.concat(F.lit("\nWrite exactly "), sentences.cast("string"), F.lit(" sentences in "), language, F.lit(".")),
        F.concat(F.lit("Tone: "), tone_guidance(tone)),
        none if rating is None else F.when(rating.isNotNull(), F.concat(F.lit("Use exactly this rating: "), rating.cast("string"), F.lit("."))),
    ))
    return F.concat_ws("\n", _block(F.concat(head, more, own)), F.array_join(orders, "\n"))


def questions_prompt(product: Column, category: Column, count: Column, language: Column) -> Column:
    """The request for questions about a product."""
    lines = F.array_compact(F.array(F.concat(F.lit("Product: "), unmarked(product)), _told("Category", category)))
    return F.concat(_block(lines), F.lit("\n\nWrite exactly "), count.cast("string"), F.lit(" questions in "), language, F.lit("."))


def request_error(n_sentences: Column, count: Column, rating: Column) -> Column:
    """The first limit that a request breaks, null if none."""
    return F.when(~n_sentences.between(*SENTENCES[:2]), "sentences").when(~count.between(*QUESTIONS[:2]), "count").when(~rating.between(*RATING[:2]), "rating")


def tone_guidance(tone: Column) -> Column:
    """What a tone asks of the writer; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in TONES.items() for x in pair]), F.lower(tone))


def generated(product: Column, answers: Column, n: int, requested: Column, title: Column, body: Column, rating: Column) -> Column:
    """struct<title, body, sentence_count, rating, ai_generated, disclosure, error> of a model's answer.

    The review rests on the reviewer's own experience only if answers came with the request; what the
    model says of itself does not count. Without a body there is an error and nothing else.
    """
    own = F.coalesce(F.size(answers) > 0, F.lit(False))
    shortened = lambda b: let(sentences(b), lambda told: F.when(F.size(told) <= n, strip(b)).otherwise(F.array_join(F.slice(told, 1, n), " ")))
    # the text is made once, however often it is named below
    return let(let(as_text(body), shortened), lambda text: _review(text, product, own, requested, title, rating))


def _review(text: Column, product: Column, own: Column, requested: Column, title: Column, rating: Column) -> Column:
    found = text.isNotNull() & (text != "")
    return F.struct(
        F.when(found, F.coalesce(as_text(title), F.concat(F.lit("Review of "), product))).alias("title"), F.when(found, text).alias("body"), F.when(found, sentence_count(text)).cast("long").alias("sentence_count"),
        F.when(found, resolve_rating(requested, rating)).alias("rating"), (~own).alias("ai_generated"), F.when(own, OWN_WORDS).otherwise(MADE_UP).alias("disclosure"), F.when(~F.coalesce(found, F.lit(False)), NO_OUTPUT).alias("error"),
    )


def questions_error(raw: Column, count: int) -> Column:
    """The error of an answer without a question, null if there is one."""
    return F.when(F.size(questions(raw, count)) == 0, NO_OUTPUT)
