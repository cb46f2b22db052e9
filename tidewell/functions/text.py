"""Canonical forms and lexical intent of search queries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORMALIZER_VERSION = 3
INTENT_VERSION = 1

#: Words that count as another word; an empty one is dropped.
SYNONYMS = {
    "checker": "validator", "tester": "validator", "verifier": "validator", "verify": "validate", "check": "validate", "test": "validate",
    "checking": "validate", "testing": "validate", "creator": "generator", "builder": "generator", "maker": "generator", "create": "generate",
    "build": "generate", "make": "generate", "lookup": "search", "finder": "search", "find": "search", "online": "", "free": "",
}
#: Words that keep their final s.
KEEP_S = {
    "css", "js", "ts", "os", "as", "is", "us", "has", "was", "its", "this", "yes", "no", "bus", "gas", "dns", "rss", "sms", "gps", "aws", "sas",
    "cms", "ios", "less", "loss", "miss", "pass", "class", "access", "process", "express", "address", "cross", "press", "stress", "progress",
    "success", "business", "wordpress", "status", "radius", "nexus", "focus", "bonus", "campus", "census", "corpus", "nucleus", "stimulus",
    "terminus", "versus", "virus", "surplus", "cactus", "analysis", "basis", "thesis", "crisis", "axis", "genesis", "synopsis", "diagnosis",
    "emphasis", "hypothesis", "synthesis", "parenthesis", "redis", "apis", "chaos", "demos", "logos", "photos", "videos", "nuxtjs", "nextjs",
    "nodejs", "reactjs", "vuejs", "angularjs", "expressjs", "nestjs", "threejs", "alpinejs", "solidjs", "sveltejs", "dejs", "bunjs", "denojs",
    "canvas", "atlas", "alias", "bias", "perhaps", "whereas", "kubernetes", "sass", "postgres", "always", "across", "previous", "various", "serious",
    "famous", "anonymous", "continuous", "dangerous", "generous", "obvious", "numerous", "curious", "nervous", "conscious",
}
#: Words between which order matters, and words after which ``to`` gives no direction.
DIRECTIONS = {"to", "into", ">", "→"}
IDIOMS = {
    "how", "what", "why", "when", "where", "who", "which", "guide", "way", "tip", "intro", "introduction", "learn", "tutorial", "step", "reason",
    "idea", "example", "benefit", "need",
}
#: Plurals that follow no rule, and words without one.
IRREGULAR = {
    "people": "person", "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse",
    "lice": "louse", "oxen": "ox", "dice": "die", "indices": "index", "matrices": "matrix", "vertices": "vertex", "appendices": "appendix",
    "criteria": "criterion", "phenomena": "phenomenon", "data": "datum", "media": "medium", "analyses": "analysis", "theses": "thesis",
    "crises": "crisis", "menus": "menu", "gurus": "guru", "axes": "axis", "bases": "base", "movies": "movie", "cookies": "cookie", "shoes": "shoe", "heroes": "hero",
    "potatoes": "potato", "tomatoes": "tomato", "echoes": "echo", "lives": "life", "knives": "knife", "wives": "wife", "leaves": "leaf",
    "halves": "half", "shelves": "shelf", "wolves": "wolf", "thieves": "thief", "loaves": "loaf",
}
UNCOUNTED = {
    "series", "species", "news", "means", "sheep", "deer", "fish", "moose", "aircraft", "software", "hardware", "information", "equipment", "money",
    "rice", "traffic", "chess",
}

QUOTES = re.compile("[\"'‘’“”`]+")
SEPARATORS = re.compile(r"[-_/.@#:+,;!?()\[\]]+")
#: Words and phrases that give away what a query is after, and the numbers of its kinds.
CUES = {
    "informational": {
        "how", "what", "why", "when", "where", "who", "which", "whose", "whom", "guide", "tutorial", "example", "examples", "meaning", "definition",
        "define", "explained", "explain", "tip", "idea", "learn", "basics", "intro", "introduction", "overview", "cheatsheet", "documentation",
        "docs", "faq",
    },
    "commercial": {
        "best", "top", "vs", "versus", "review", "comparison", "compare", "alternative", "alternatives", "cheapest", "recommended", "popular",
    },
    "transactional": {
        "buy", "price", "pricing", "cost", "cheap", "coupon", "deal", "discount", "order", "purchase", "download", "subscribe", "subscription",
        "signup", "trial", "demo", "install", "free", "sale", "quote", "checkout", "cart",
    },
}
BUYING_PHRASES = r"\b(for sale|sign up|near me|how much)\b"
CODES = {"unknown": 0, "informational": 1, "commercial": 2, "transactional": 3}
HOW_TO_BIT = 4


def folded(text: str) -> str:
    """Compatibility forms as plain letters, without marks."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def singular(word: str) -> str:
    """A word without its plural ending, by a small set of English rules; protected and non-English words stay."""
    if len(word) <= 3 or word in KEEP_S or word in UNCOUNTED or word.endswith("sis") or not "a" <= word[-1] <= "z":
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    if not word.endswith("s") or word.endswith(("ss", "us", "is")):
        return word
    if word.endswith("ies"):
        return word[:-3] + "y" if len(word) > 4 else word[:-1]
    if word.endswith(("sses", "shes", "ches", "xes", "zzes")):
        return word[:-2]
    return word[:-1]


def normalize_query(query: str) -> str:
    """The form under which variants of a query group: folded, without noise, singular, and sorted unless order gives a direction."""
    text = " ".join(SEPARATORS.sub(" ", QUOTES.sub("", folded(query).lower())).split())
    if not text:
        return ""
    words = text.split(" ")
    kept = [s for w in words if (s := SYNONYMS.get(w, w))] or words
    tokens = [singular(w) for w in kept]
    directed = any(t in DIRECTIONS and tokens[i] not in IDIOMS for i, t in enumerate(tokens[1:-1]))
    return " ".join(tokens if directed else sorted(tokens))


def intent_text(query: Column) -> Column:
    """A query as intent cues are looked up in it. Only unmarked Latin letters hold cues, so no folding is needed beyond common marks."""
    plain = F.translate(F.lower(query), "áàâäãéèêëíìîïóòôöõúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[-_/.@#:+]+", " "), r"\s+", " "))


def intent_code(query: Column) -> Column:
    """0 unknown, 1 informational, 2 commercial, 3 transactional, plus 4 for how-to queries; the most buying cue wins."""
    text = intent_text(query)
    words = F.split(text, " ")
    has = lambda kind: F.arrays_overlap(words, F.array(*map(F.lit, sorted(CUES[kind]))))
    how_to = text.rlike(r"\bhow to\b")
    kind = (
        F.when(has("transactional") | text.rlike(BUYING_PHRASES), CODES["transactional"])
        .when(has("commercial"), CODES["commercial"])
        .when(has("informational") | how_to, CODES["informational"])
        .otherwise(CODES["unknown"])
    )
    return kind + F.when(how_to, HOW_TO_BIT).otherwise(0)


def query_dim(queries: DataFrame, normalize: Callable[[str], str] = normalize_query) -> DataFrame:
    """One row for each distinct query that isn't blank, with canonical form and intent.

    Python runs once for each distinct query, never for each fact row.
    """

    def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda q: normalize(q) or q)

    udf = F.pandas_udf(canonical, "string")
    distinct = queries.select("query").where(F.trim("query") != "").distinct()
    return distinct.select(
        "query", udf("query").alias("query_canonical"), intent_code(F.col("query")).alias("intent_code"),
        F.lit(NORMALIZER_VERSION).alias("normalizer_version"), F.lit(INTENT_VERSION).alias("intent_version"),
    )
