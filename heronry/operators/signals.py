"""What a query looks like, as a struct of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import array_of, clamp, detect_language, strip_punctuation, trim, words
from ..functions.words import NEGATIONS, QUESTION_WORDS, SIGNAL_STOPWORDS

_BEFORE, _BEHIND = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def specific(w: Column) -> Column:
    """A number, a code in capitals, letters and digits around a separator, or a hexadecimal number."""
    mixed = w.rlike(r"[_\-./]") & w.rlike("[a-zA-Z]") & w.rlike("[0-9]")
    return w.rlike("^[0-9]+$") | w.rlike("^[A-Z0-9]{3,}$") | mixed | w.rlike("^0x[0-9a-fA-F]+$")


def code_like(w: Column) -> Column:
    """camelCase, snake_case, dotted.names, scopes::, calls( and assignments=."""
    bare = strip_punctuation(w)
    snake = bare.contains("_") & bare.rlike("(?i)^[a-z][a-z0-9_]{1,64}$")
    dotted = bare.rlike(r"(?i)[a-z]\.[a-z]") & (F.length(bare) >= 5)
    assigned = bare.contains("=") & bare.rlike("[a-zA-Z]") & (F.length(bare) >= 3)
    return bare.rlike("[a-z][A-Z]") | snake | dotted | bare.contains("::") | bare.rlike(r"^[a-zA-Z_][A-Za-z0-9_]{0,128}\(") | assigned


def named(w: Column) -> Column:
    """A capitalised word of two letters and more that is no stopword; all capitals count from four letters on."""
    bare = strip_punctuation(w)
    stop = F.array_contains(array_of(SIGNAL_STOPWORDS), F.lower(bare))
    return (F.length(bare) >= 2) & bare.rlike("^[A-Z]") & ~stop & (bare.rlike("[a-z]") | (F.length(bare) >= 4))


def date_or_version(c: Column) -> Column:
    """A year, a version number, an RFC or a CVE."""
    years = rf"{_BEFORE}(19|20|21)[0-9]{{2}}{_BEHIND}"
    versions = rf"{_BEFORE}v?[0-9]+\.[0-9]+(\.[0-9]+)?{_BEHIND}"
    numbers = rf"(?i){_BEFORE}(RFC\s?[0-9]{{3,5}}|CVE-[0-9]{{4}}-[0-9]{{4,7}}){_BEHIND}"
    return c.rlike(years) | c.rlike(versions) | c.rlike(numbers)


def question(c: Column) -> Column:
    return c.rlike(r"[?]\s*$") | c.rlike(rf"(?i)^({'|'.join(QUESTION_WORDS)}){_BEHIND}")


def question_type(c: Column) -> Column:
    head = F.lower(c)
    kind = (
        F.when(head.rlike(f"^(where|which|when|who){_BEHIND}"), "factoid")
        .when(head.rlike(f"^(why|how){_BEHIND}"), "procedural")
        .when(head.rlike(rf"(?U)^what\s+(was|were|does|do|are|is)(?![\p{{L}}\p{{N}}_])"), "definitional")
    )
    return F.when(question(c), kind)


def signals(query: Column | str) -> Column:
    """The twelve signals of a query; those of a null query are those of an empty one."""
    text = trim(F.coalesce(F.col(query) if isinstance(query, str) else query, F.lit("")))
    own = words(text)
    n = F.size(own)
    lower = F.transform(own, F.lower)
    letters = F.aggregate(own, F.lit(0), lambda s, w: s + F.length(w))
    exact, code, dated = F.exists(own, specific), F.exists(own, code_like), date_or_version(text)
    stop = F.size(F.filter(lower, lambda w: F.array_contains(array_of(SIGNAL_STOPWORDS), w)))
    share = F.when(n == 0, F.lit(0.0)).otherwise(stop / F.greatest(n, F.lit(1)))
    ambiguity = share + F.when(n < 3, 0.4).otherwise(0.0) + F.when(exact | code | dated, -0.3).otherwise(0.0)
    return F.struct(
        n.alias("word_count"),
        F.when(n == 0, F.lit(0.0)).otherwise(letters / F.greatest(n, F.lit(1))).alias("avg_word_len"),
        text.rlike("[\"'][^\"']{2,}[\"']").alias("has_quoted_phrase"),
        exact.alias("has_specific_tokens"),
        question(text).alias("is_question"),
        clamp(ambiguity, 0.0, 1.0).alias("ambiguity"),
        F.exists(F.slice(own, 2, F.greatest(n, F.lit(1))), named).alias("has_named_entity"),
        code.alias("has_code_like"),
        dated.alias("has_date_or_version"),
        question_type(text).alias("question_type"),
        F.arrays_overlap(lower, array_of(NEGATIONS)).alias("has_negation"),
        detect_language(text).alias("language"),
    )
