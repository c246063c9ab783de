"""Names, tokens and sets of words, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Combining marks, which are dropped.
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def _decomposed(first: int, last: int) -> tuple[str, str]:
    """Letters that decompose into one letter and combining marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c)).translate(dict.fromkeys(map(ord, _MARKS)))) for c in range(first, last)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Latin, Greek and Cyrillic letters with marks, and the letters without them.
MARKED, PLAIN = _decomposed(0xC0, 0x2000)


def strip_marks(text: Column) -> Column:
    return F.translate(text, MARKED + _MARKS, PLAIN)


def normalize_name(name: Column) -> Column:
    """Lower case, no marks, single spaces."""
    return F.trim(F.regexp_replace(strip_marks(F.lower(name)), r"\s+", " "))


def normalize_for_blocklist(text: Column) -> Column:
    """Lower case, no marks, everything but a-z and 0-9 a single space: paraphrases pass, near-exact repeats don't."""
    return F.trim(F.regexp_replace(strip_marks(F.lower(text)), r"[^a-z0-9]+", " "))


def blocklist_hash(text: Column) -> Column:
    return F.sha2(normalize_for_blocklist(text), 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def words(text: Column, longer: int) -> Column:
    """Distinct words between white space with more than so many characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > longer))


def terms(text: Column, longer: int = 2) -> Column:
    """Runs of ASCII letters, digits and _ of more than so many characters, with repetition."""
    return F.filter(F.split(F.lower(text), r"[^a-zA-Z0-9_]+"), lambda w: F.length(w) > longer)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2)))))


def entity_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.8 if one contains the other, else Dice of the sets of bigrams; 0 if either is empty."""
    x, y = bigrams(a), bigrams(b)
    dice = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.8).otherwise(dice)


def dense_cosine(a: Column, b: Column) -> Column:
    """0 if either is null or all zeros, or if lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), 0.0).otherwise(F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


def search_query(message: Column, project: Column, stopwords: list[str]) -> Column:
    """Terms of a message without filler, in order, after the project's name; the message itself if too little is left."""
    clean = F.regexp_replace(F.lower(message), r"[^\w\sáàâãéèêíìîóòôõúùûçñ]", " ")
    kept = F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(clean, r"\s+", " ")), " "), lambda w: (F.length(w) >= 3) & ~w.isin(stopwords)))
    query = F.concat_ws(" ", project, F.array_join(kept, " "))
    return F.when(F.length(query) >= 5, query).otherwise(message)


def is_private_ip(ip: Column) -> Column:
    """Private and reserved addresses; what can't be read counts as private."""
    v = F.regexp_replace(F.lower(F.trim(ip)), r"^\[|\]$", "")
    octet = r"(\d{1,9})\.(\d{1,9})\.(\d{1,9})\.(\d{1,9})"

    def v4(x: Column) -> Column:
        a, b = (F.regexp_extract(x, rf"^{octet}$", k).cast("int") for k in (1, 2))
        return (a.isin(127, 10, 0)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))

    mapped = F.substring(v, 8, 100)
    v6 = v.isin("::", "::1") | v.rlike("^fe[89ab][0-9a-f]:") | v.startswith("fc") | v.startswith("fd")
    v6 = F.when(v6, True).when(v.startswith("::ffff:"), F.when(mapped.rlike(rf"^{octet}$"), v4(mapped)).otherwise(True)).otherwise(False)
    return F.coalesce(F.when(F.contains(v, F.lit(":")), v6).when(v.rlike(rf"^{octet}$"), v4(v)).otherwise(True), F.lit(True))


def page_range(spec: Column) -> Column:
    """Sorted zero-based pages of a specification like "2,5,8-10"."""
    parts = F.filter(F.split(F.regexp_replace(spec, r"\s+", ""), ","), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    low = lambda p: F.split_part(p, F.lit("-"), F.lit(1)).cast("int")
    high = lambda p: F.split_part(p, F.lit("-"), F.lit(-1)).cast("int")
    pages = F.transform(F.filter(parts, lambda p: (low(p) >= 1) & (high(p) >= low(p))), lambda p: F.sequence(low(p) - 1, high(p) - 1))
    return F.array_sort(F.array_distinct(F.flatten(pages)))


def scope_of(tenant: Column, project: Column) -> Column:
    """tenant or tenant:project, white space in the project as _."""
    p = F.regexp_replace(F.trim(project), r"\s+", "_")
    return F.when(project.isNull() | (p == ""), tenant).otherwise(F.concat(tenant, F.lit(":"), p))


def graph_id(scope: Column, name: Column) -> Column:
    return F.when(scope.isNull() | (scope == ""), normalize_name(name)).otherwise(F.concat(scope, F.lit("::"), normalize_name(name)))


def graph_scope(node: Column) -> Column:
    """What stands before the first "::", if anything does; else null."""
    return F.when(F.instr(node, "::") > 1, F.substring_index(node, "::", 1))
