"""Scalar text functions (X1-X29): column expressions, no user-defined functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import ontology

#: What parts words.  One split beats an extraction of each word.
BETWEEN = r"[^\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def word_set(text: Column) -> Column:
    """X1"""
    return F.array_distinct(words(text))


def content_words(text: Column, stops: list[str]) -> Column:
    """X2"""
    return F.array_except(words(text), F.array(*map(F.lit, stops)))


def keywords(text: Column) -> Column:
    """X2, for keywords: order and repeats stay"""
    stops = F.array(*map(F.lit, ontology.KEYWORD_STOPS))
    return F.filter(words(text), lambda w: ~F.array_contains(stops, w) & (F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """0 if one is empty"""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column, least: int = 5) -> Column:
    """X4"""
    x, y = (F.filter(c, lambda w: F.length(w) >= least) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def est_tokens(text: Column) -> Column:
    """X5"""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def fit_to_window(text: Column, used: int, limit: int, reserve: int, marker: str = "\n\n[truncated]") -> Column:
    """``used`` tokens are taken by what stands before"""
    left = limit - reserve - used - 2000
    left = 5000 if left < 1000 else left
    fits = used + est_tokens(text) + 2000 <= limit - reserve
    return F.when(fits, text).otherwise(F.concat(F.substring(text, 1, left * 4), F.lit(marker)))


def content_hash(text: Column) -> Column:
    """X7"""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))


def preview(text: Column) -> tuple[Column, Column]:
    """The first ten headings, and the first long line that is none"""
    lines = F.split(text, "\n")
    heads = F.transform(F.filter(lines, lambda x: x.rlike(r"^#{1,3}\s+\S")), lambda x: F.regexp_replace(x, r"^#{1,3}\s+", ""))
    body = F.filter(lines, lambda x: ~x.startswith("#") & ~x.startswith("---") & (F.length(F.trim(x)) > 20))
    return F.array_join(F.slice(heads, 1, 10), " | "), F.substring(F.trim(F.get(body, 0)), 1, 500)


def section(body: Column, title: str) -> Column:
    """The lines below a second-level heading, up to the next one"""
    return F.split_part(F.split_part(F.concat(F.lit("\n"), body, F.lit("\n## ")), F.lit(f"\n## {title}\n"), F.lit(2)), F.lit("\n## "), F.lit(1))


def open_questions(body: Column) -> Column:
    """X10"""
    lines = F.filter(F.split(section(body, "Open Questions"), "\n"), lambda x: x.rlike("^\\s*[-*] "))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^\\s*[-*] ", ""))), lambda x: F.length(x) > 5)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def overview(text: Column, n: int = 3) -> Column:
    """X11"""
    return F.array_join(F.slice(sentences(text), 1, n), " ")


def embedding_text(name: Column, kind: Column, description: Column, relations: Column, body: Column) -> Column:
    """Empty parts are left out"""
    start = F.trim(F.regexp_replace(F.substring(body, 1, 150), "#", ""))
    parts = F.array(name, kind, description, F.array_join(F.slice(relations, 1, 5), ", "), start)
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " | ")


def intents(question: Column) -> dict[str, Column]:
    """Weight of each intent, null where no pattern matches"""
    low = F.lower(F.coalesce(question, F.lit("")))
    out = {}
    for intent, patterns in ontology.INTENTS.items():
        n = sum((low.rlike(p).cast("int") for p in patterns), F.lit(0))
        out[intent] = F.when(n > 0, F.least(F.lit(1.0), 0.6 + 0.15 * (n - 1)))
    none = F.coalesce(*out.values()).isNull()
    out["entity"] = F.when(none, 0.3).otherwise(out["entity"])
    return out


def layer_priorities(weights: dict[str, Column]) -> dict[str, Column]:
    """At least 1 for each layer"""
    top = F.greatest(*[F.coalesce(w, F.lit(0.0)) for w in weights.values()])
    out = {}
    for layer in ontology.LAYERS:
        boosts = [1 + (b[layer] - 1) * F.coalesce(weights[i] / top, F.lit(0.0)) for i, b in ontology.INTENT_LAYERS.items() if layer in b]
        out[layer] = F.greatest(F.lit(1.0), *boosts) if boosts else F.lit(1.0)
    return out


def citations(answer: Column) -> Column:
    """X15"""
    return F.regexp_extract_all(answer, F.lit(r"\[([^\]]+)\]"), 1)


def answer_score(answer: Column) -> Column:
    """The verdict nearest to the end in the last five lines"""
    last = F.reverse(F.split(F.upper(answer), "\n"))
    verdict = F.transform(F.slice(last, 1, 5), lambda x: F.when(x.contains("NOT_ANSWERABLE"), "not_answerable").when(x.contains("PARTIAL"), "partial").when(x.contains("ANSWERABLE"), "answerable"))
    return F.coalesce(F.get(F.filter(verdict, lambda v: v.isNotNull()), 0), F.lit("not_answerable"))


def ddc_class(score: Column) -> Column:
    return F.when(score == "answerable", "CLEAN").when(score == "partial", "INCOMPLETE").otherwise("MISSING")


def extract_json(text: Column) -> Column:
    """The object itself, else what a fence holds, else what the outermost braces hold; null if none parses"""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & bare(c).startswith("{"), bare(c))
    return F.coalesce(ok(text), ok(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)), ok(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))


def confidence_tier(c: Column) -> Column:
    """X22"""
    return F.when(c >= 0.85, "solid").when(c >= 0.55, "muted").otherwise("sketched")


def slug(text: Column) -> Column:
    """X24"""
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, 60), "^-+|-+$", "")


def humanize(text: Column) -> Column:
    return F.initcap(F.regexp_replace(text, "_", " "))


def is_kebab(text: Column) -> Column:
    """X25"""
    return text.rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def hedged(text: Column) -> Column:
    """X27"""
    return F.filter(sentences(text), lambda s: F.lower(s).rlike(r"\b(maybe|likely|probably|seems|appears to|could be)\b"))


def clean_body(body: Column, name: Column) -> Column:
    """Without the first heading if it is the name, and without the open questions"""
    head = F.concat(F.lit("# "), name, F.lit("\n"))
    start = F.when(F.startswith(body, head), F.substring(body, F.length(head) + 1, F.length(body))).otherwise(body)
    return F.trim(F.split_part(start, F.lit("\n## Open Questions"), F.lit(1)))


def icon(entity_type: Column) -> Column:
    """Initials, or the first two letters of a single word"""
    parts = F.split(entity_type, "-")
    return F.upper(F.when(F.size(parts) == 1, F.substring(entity_type, 1, 2)).otherwise(F.substring(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), ""), 1, 3)))


def typed_dir(entity_type: Column) -> Column:
    return F.when(entity_type.endswith("s"), F.concat(entity_type, F.lit("es"))).otherwise(F.concat(entity_type, F.lit("s")))
