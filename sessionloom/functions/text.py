"""Text functions as column expressions; all stay in generated code, none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that JavaScript's trim removes and its \s matches.
JS_SPACE = r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: str | Column) -> Column:
    return F.regexp_replace(col(c), f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def js_length(c: str | Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def tokens(c: str | Column, lower: bool = True) -> Column:
    """Runs of letters, digits and underscores; repeated ones stay."""
    text = F.lower(col(c)) if lower else col(c)
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def token_set(c: str | Column) -> Column:
    return F.array_distinct(tokens(c))


def jaccard(a: Column, b: Column, raw_a: Column, raw_b: Column) -> Column:
    """Similarity of two token sets; where both are empty, 1 if the trimmed texts are equal, else 0."""
    shared = F.size(F.array_intersect(a, b))
    none = (F.size(a) == 0) & (F.size(b) == 0)
    same = (js_trim(raw_a) == js_trim(raw_b)).cast("double")
    return F.when(none, same).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def count_apart(text: Column, needle: str) -> Column:
    """Occurrences of a needle that do not overlap, in any case; an empty needle has none."""
    n = needle.lower()
    if not n:
        return F.lit(0)
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(n)))) / len(n)).cast("long")


def count_overlapping(text: Column, token: str) -> Column:
    """Occurrences of a token (letters, digits, underscores) that may overlap, in any case."""
    return F.regexp_count(F.lower(text), F.lit(f"(?={token.lower()})")).cast("long")


def short_hash(c: str | Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(col(c), 256), 1, 16))


def record_id(project: str | Column, title: str | Column, day: str | Column) -> Column:
    """``mem_`` with the UTC day and the first six hex digits of the hash of project and title."""
    digest = F.sha2(F.concat(col(project), F.lit("\n"), col(title)), 256)
    return F.concat(F.lit("mem_"), F.date_format(col(day), "yyyyMMdd"), F.lit("_"), F.substring(digest, 1, 6))


def project_slug(directory: str | Column) -> Column:
    base = F.regexp_extract(F.regexp_replace(col(directory), "/+$", ""), "([^/]*)$", 1)
    slug = F.regexp_replace(F.regexp_replace(F.lower(base), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(slug != "", slug).otherwise("unknown")


def iso_ms(ms: str | Column) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def hour_minute(ms: str | Column) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), "HH:mm")


def confidence(sessions: Column, approved: Column, contradicted: Column) -> Column:
    """0.5, 0.15 more for each further session, 0.2 for approval, 0.25 less if contradicted; kept in [0.1, 0.95]."""
    x = F.lit(0.5) + F.lit(0.15) * (sessions - 1) + F.when(approved, 0.2).otherwise(0.0) - F.when(contradicted, 0.25).otherwise(0.0)
    return F.floor(F.least(F.lit(0.95), F.greatest(F.lit(0.1), x)) * 100 + 0.5) / 100.0


def anchors(body: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(body), F.lit(r"\{#([^}]+)\}"), 1))


def words(c: str | Column) -> Column:
    """Number of words between white space of the trimmed text."""
    return F.size(F.split(js_trim(c), f"{JS_SPACE}+"))


def without_fences(c: str | Column) -> Column:
    t = F.regexp_replace(js_trim(c), r"^```(?:json)?\s*", "")
    return js_trim(F.regexp_replace(t, r"\s*```\s*$", ""))


# Labels and patterns of secrets with a known form.
SECRET_FORMS = {
    "pem-private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "aws-access-key": r"AKIA[0-9A-Z]{16}",
    "token-prefix": r"\b(?:sk|ghp|gho|xox[bpas])[-_][A-Za-z0-9]{16,}\b",
}


# Shapes of long tokens that are no secrets.
HEX_DIGEST = r"^(?:sha\d+:)?[0-9a-fA-F]{16,}$"
UUID = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def secret_labels(c: str | Column) -> Column:
    """Labels of the secrets in a text, ``high-entropy-token`` last and once.

    A token between white space is of high entropy if it has 32 characters, three classes of lower, upper, digit and
    other, and a character beyond letters, digits and ``:-._/``; or 48 letters and digits of all three classes. URLs,
    hex digests and UUIDs are none. Null and empty texts have no label.
    """
    text = F.coalesce(col(c), F.lit(""))
    forms = [F.when(text.rlike(p), F.lit(label)) for label, p in SECRET_FORMS.items()]

    def noisy(t: Column) -> Column:
        has = [t.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]
        benign = t.contains("://") | t.rlike(HEX_DIGEST) | t.rlike(UUID)
        mixed = (sum(has[1:], has[0]) >= 3) & t.rlike(r"[^A-Za-z0-9:\-._/]")
        plain = (F.length(t) >= 48) & t.rlike("^[A-Za-z0-9]+$") & (has[0] + has[1] + has[2] == 3)
        return (F.length(t) >= 32) & ~benign & (mixed | plain)

    entropy = F.when(F.exists(F.split(text, f"{JS_SPACE}+"), noisy), F.lit("high-entropy-token"))
    return F.array_compact(F.array(*forms, entropy))
