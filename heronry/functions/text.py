"""Text functions on columns, all built-in expressions. Regular expressions spell out ASCII word boundaries and Unicode white space."""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter import stem
from .words import STOPWORDS

SPACE = r"(?U)\s"
_SCRIPTS = (
    ("ja", r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]"),
    ("ko", r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"),
    ("zh", r"[\x{4E00}-\x{9FFF}]"),
    ("ru", r"[\x{0400}-\x{04FF}]"),
    ("ar", r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]"),
    ("hi", r"[\x{0900}-\x{097F}]"),
    ("th", r"[\x{0E00}-\x{0E7F}]"),
    ("he", r"[\x{0590}-\x{05FF}]"),
    ("el", r"[\x{0370}-\x{03FF}]"),
)
_ABBREVIATIONS = ("Dr", "Inc", "Jr", "Ltd", "Mr", "Mrs", "Ms", "Sr", "St", "e.g", "i.e")
_SHORT = r"(?U)(?<![A-Za-z0-9_])(" + "|".join(a.replace(".", r"\.") for a in _ABBREVIATIONS) + r")\.\s"
_INITIAL = r"(?U)(?<![A-Za-z0-9_])([A-Z])\.\s"
_DOT = "<DOT>"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_of(words: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def trim(c: Column | str) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(column(c), r"(?U)^\s+|\s+$", "")


def words(c: Column | str) -> Column:
    """The parts between white space."""
    return F.filter(F.split(trim(c), r"(?U)\s+"), lambda w: F.length(w) > 0)


def tokenize(c: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    spaced = F.regexp_replace(F.lower(column(c)), r"(?U)[^\p{L}\p{N}\s]", " ")
    return F.filter(F.split(spaced, r"(?U)\s+"), lambda t: F.length(t) > 0)


def without_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.array_contains(array_of(STOPWORDS), t))


def tokenize_advanced(df: DataFrame, text: str, tokens: str, stemmed: bool = False, drop_stopwords: bool = False) -> DataFrame:
    """df with a column of tokens, without stopwords and stemmed if asked. Stemming takes one Arrow pass."""
    found = tokenize(text)
    if drop_stopwords:
        found = without_stopwords(found)
    df = df.withColumn(tokens, found)
    return df.withColumn(tokens, stem_all(F.col(tokens))) if stemmed else df


def stem_all(tokens: Column) -> Column:
    """Stems of the tokens of each row; each distinct token of an Arrow batch is stemmed once, those seen before not at all."""

    @F.arrow_udf("array<string>")
    def stemmed(own: pa.Array) -> pa.Array:
        flat = own.flatten().dictionary_encode()
        stems = pa.array([_stem(t) for t in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
        size = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(size)])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(pc.is_null(own).to_numpy(zero_copy_only=False), False)), stems)

    return stemmed(tokens)


@lru_cache(1 << 17)
def _stem(token: str) -> str:
    return stem(token)


def split_sentences(c: Column | str) -> Column:
    """Sentences: cut behind . ! ? where white space and a capital, quote or bracket follow; texts of one sentence at line breaks."""
    text = column(c)
    # the expression is looked for only in texts that may have one of them
    some = reduce(lambda a, b: a | b, (F.contains(text, F.lit(f"{a}.")) for a in _ABBREVIATIONS))
    kept = F.regexp_replace(F.when(some, F.regexp_replace(text, _SHORT, f"$1{_DOT} ")).otherwise(text), _INITIAL, f"$1{_DOT} ")
    parts = F.split(kept, r"(?U)(?<=[.!?])\s+(?=[A-Z\(\[\"'])")
    parts = _neat(F.transform(parts, lambda p: F.replace(p, F.lit(_DOT), F.lit("."))))
    # bound to a variable, or the parts are worked out once for their number and again for themselves
    return F.element_at(F.transform(F.array(parts), lambda p: F.when(F.size(p) <= 1, _neat(F.split(text, r"\n+"))).otherwise(p)), 1)


def _neat(parts: Column) -> Column:
    # between two visible ASCII characters there is nothing to trim
    bare = lambda p: F.ascii(F.substring(p, 1, 1)).between(33, 126) & F.ascii(F.substring(p, -1, 1)).between(33, 126)
    return F.filter(F.transform(parts, lambda p: F.when(bare(p), p).otherwise(trim(p))), lambda p: F.length(p) > 0)


def detect_language(c: Column | str) -> Column:
    """The language of the first script found, by order of a fixed list; en for Latin and no text."""
    out = F.lit("en")
    for code, script in reversed(_SCRIPTS):
        out = F.when(column(c).rlike(script), code).otherwise(out)
    return out


def strip_punctuation(c: Column) -> Column:
    """Without up to 64 quotes, brackets and marks at each end."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\"'(\[`]{1,64}", ""), r"[\"')\].,?!:`]{1,64}$", "")


def phrases(c: Column | str) -> Column:
    """Lower-case quoted spans of three characters and more, then, for two to six other tokens, their 3-grams and 2-grams without stopwords."""
    text = column(c)
    quoted = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[\"']([^\"']+)[\"']"), F.lit(1)), trim), lambda q: F.length(q) >= 3)
    rest = words(F.regexp_replace(text, "[\"'][^\"']+[\"']", " "))

    def grams(n: int) -> Column:
        at = F.when(F.size(rest) >= n, F.sequence(F.lit(1), F.size(rest) - (n - 1))).otherwise(F.array().cast("array<int>"))
        found = F.filter(F.transform(at, lambda i: F.slice(rest, i, n)), lambda g: ~F.exists(g, lambda t: F.array_contains(array_of(STOPWORDS), F.lower(t))))
        return F.filter(F.transform(found, lambda g: F.lower(F.array_join(g, " "))), lambda p: F.length(p) >= 5)

    windows = F.when(F.size(rest).between(2, 6), F.concat(grams(3), grams(2))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(quoted, F.lower), windows)


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(column(c).cast("string"), 256)


def utf8_length(c: Column | str) -> Column:
    return F.octet_length(column(c))


def context_key(document: Column | str, chunk: Column | str) -> Column:
    """Key of a chunk in its document: hash of both, each behind its length in bytes."""
    return F.sha2(F.concat(*(x for c in (document, chunk) for x in (utf8_length(c).cast("string"), F.lit(":"), column(c)))), 256)


def defuse(c: Column | str) -> Column:
    """Closing document and chunk tags broken by a zero-width joiner, so that a text can't end the prompt's section it is in."""
    out = column(c)
    for tag in ("document", "chunk"):
        out = F.regexp_replace(out, rf"(?iU)<(\s*)/(\s*)({tag})(\s*)>", "<$1‍/$2$3$4>")
    return out


def contextual_prompt(document: Column | str, chunk: Column | str, template: str) -> Column:
    """The template with its slots {WHOLE_DOCUMENT} and {CHUNK_CONTENT} filled."""
    out = F.replace(F.lit(template), F.lit("{WHOLE_DOCUMENT}"), defuse(document))
    return F.replace(out, F.lit("{CHUNK_CONTENT}"), defuse(chunk))


def fingerprint(df: DataFrame, id_: str = "id", content: str = "content", metadata: str | None = "metadata") -> str:
    """A hash of a set of documents, summed over rows; unlike one of ids and contents alone it sees a change of metadata."""
    parts = [F.col(id_).cast("string"), F.col(content)]
    if metadata and metadata in df.columns:
        parts.append(F.to_json(metadata))
    one = F.sha2(F.concat_ws("\u0000", *(F.coalesce(p, F.lit("\u0001")) for p in parts)), 256)
    pieces = [F.sum(F.conv(F.substring(one, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    row = df.agg(F.count("*"), *pieces).first()
    return ":".join(str(x or 0) for x in row)


def sigmoid(c: Column | str) -> Column:
    x = column(c)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), column(c)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the length of the shorter array."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product over the norms, of both cut to the shorter length; 0 where a norm is."""
    a, b = column(a), column(b)
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(norm == 0, F.lit(1.0)).otherwise(norm)
