"""Token, slug and similarity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import RELATIONS, STOPWORDS


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column) -> Column:
    """The set of Unicode words of three characters or more, in lower case."""
    return F.array_distinct(F.filter(_all(F.lower(text), r"(?U)\w+"), lambda x: F.length(x) > 2))


def rank_tokens(text: Column) -> Column:
    """The set of runs of ASCII letters and digits, or of Hangul, in lower case."""
    return F.array_distinct(_all(F.lower(text), "[0-9a-z]+|[가-힣]+"))


def word_tokens(text: Column) -> Column:
    """All Unicode words in order, in lower case."""
    return _all(F.lower(text), r"(?U)\w+")


def key_tokens(text: Column) -> Column:
    """ASCII words in order, without stop words and single characters."""
    return F.filter(_all(F.lower(text), "[a-z0-9]{2,}"), lambda x: ~x.isin(*STOPWORDS))  # looked up in a set of literals, not in an array


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def containment(part: Column, whole: Column) -> Column:
    """The share of ``part``'s members that ``whole`` has; 0 if it has none."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(F.lit(0.0))


def overlap_score(query: Column, text: Column) -> Column:
    """Sum over the query's tokens of ln(1 + frequency in the text), over the query's length and one."""
    own = F.filter(text, lambda x: F.array_contains(query, x))  # few: the text is gone over once and not for each of the query's tokens
    hits = F.transform(query, lambda q: F.log1p(F.size(F.filter(own, lambda x: x == q)).cast("double")))
    return F.aggregate(hits, F.lit(0.0), lambda a, x: a + x) / (F.size(query) + 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, in doubles; 0 if either is zero, the longer one cut."""
    n = F.least(F.size(a), F.size(b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(F.lit(0.0))


def one_line(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_of(text: Column, limit: int = 80) -> Column:
    return F.substring(one_line(text), 1, limit)


def slug(text: Column, limit: int = 80) -> Column:
    """Lower case, runs of other than letters and digits made hyphens; what is cut gets a hash of the whole."""
    full = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(F.length(full) > limit, F.concat(F.substring(full, 1, limit), F.lit("-"), F.substring(F.sha2(full, 256), 1, 8))).otherwise(full)


def edge_name(predicate: Column) -> Column:
    """A free predicate as an edge type, or null where nothing usable is left."""
    name = F.upper(F.regexp_replace(F.regexp_replace(predicate, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(name.rlike("^[A-Z][A-Z0-9_]*$"), name)


def relation(predicate: Column) -> Column:
    """Canonical relation of a predicate: struct of relation, normalized name, whether it was folded, whether nothing fitted."""
    name = edge_name(predicate)
    pairs = [x for canon, also in sorted(RELATIONS.items()) for one in (canon, *sorted(s.upper() for s in also)) for x in (F.lit(one), F.lit(canon))]
    found = F.element_at(F.create_map(*pairs), F.coalesce(name, F.lit("")))
    return F.struct(F.coalesce(found, F.lit("RELATES_TO")).alias("relation"), name.alias("name"), (found.isNotNull() & (found != name)).alias("folded"), found.isNull().alias("fallback"))


def content_key(*parts: Column) -> Column:
    """SHA-256 of the non-empty parts, joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *(F.when(p != "", p) for p in parts)), 256)


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def truncated(text: Column, limit: int, marker: str = "") -> Column:
    """At most ``limit`` characters, the marker counted; the text itself if it fits."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - len(marker)), F.lit(marker))).otherwise(text)


def head_and_tail(text: Column, budget: int, between: str = "\n[...]\n") -> Column:
    """The first five eighths of the budget and the rest from the end."""
    head = int(budget * 0.625)
    return F.when(F.length(text) > budget, F.concat(F.substring(text, 1, head), F.lit(between), F.right(text, F.lit(budget - head)))).otherwise(text)
