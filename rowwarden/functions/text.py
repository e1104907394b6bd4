"""Text expressions: folding to ASCII, name tokens, similarities and neutralised text. All are JVM-side but where said."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that say nothing about which file a dictionary describes.
STOP_WORDS = (
    "metadados", "metadado", "dicionario", "dicionarios", "de", "da", "do", "das", "dos", "dados", "e", "data", "dictionary", "csv", "json", "xml", "pdf", "xlsx", "xls",
    "variaveis", "variavel", "tabela", "tabelas", "campos", "arquivo", "the", "of", "schema", "esquema", "layout", "zip", "download",
)
#: Connectives left out when spellings are compared.
CONNECTIVES = ("de", "da", "do", "das", "dos", "e", "of", "the")


def _folded(ch: str) -> str:
    return unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()


_FOLDS = {ch: f for c in range(0x80, 0x30000) if unicodedata.decomposition(ch := chr(c)) and (f := _folded(ch))}
_ONE = {ch: f for ch, f in _FOLDS.items() if len(f) == 1}
#: Ligatures, fractions, numbers in signs and the like: one character that several ASCII ones stand for.
_SEVERAL = {ch: f for ch, f in _FOLDS.items() if len(f) > 1}
_FROM, _TO = "".join(_ONE), "".join(_ONE.values())


def _ranges(chars: list[str], gap: int = 64) -> str:
    """A class of few ranges that has all the characters, and others between them."""
    ends: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ends and c - ends[-1][1] <= gap:
            ends[-1][1] = c
        else:
            ends.append([c, c])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ends) + "]"


_ANY_SEVERAL = _ranges(list(_SEVERAL))


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition of every character, of which the ASCII ones stay."""
    whole = F.coalesce(c, F.lit(""))
    text = F.translate(whole, _FROM, _TO)
    table = F.from_json(F.lit(json.dumps(_SEVERAL)), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(text, ""), lambda ch: F.when(ch.rlike(_ANY_SEVERAL), F.coalesce(F.try_element_at(table, ch), ch)).otherwise(ch)), "")
    folded = F.regexp_replace(F.when(text.rlike(_ANY_SEVERAL), spelled).otherwise(text), r"[^\x00-\x7F]", "")
    return F.when(whole.rlike(r"[^\x00-\x7F]"), folded).otherwise(whole)


def norm(c: Column) -> Column:
    """Lower case, ASCII, everything else a single blank."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", " "))


def normalise(c: Column) -> Column:
    """Upper case, ASCII, white space collapsed."""
    return F.trim(F.regexp_replace(F.upper(ascii_fold(c)), r"\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(norm(c), " "), lambda w: w != "")


def tokens(c: Column) -> Column:
    """The distinct words of a name that may tell it from others."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(words(c), lambda w: ~F.array_contains(stop, w) & ~w.rlike("^[0-9]+$")))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.coalesce(F.try_divide(both, either), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return overlap(tokens(a), tokens(b))


def name_score(dictionary: Column, resource: Column) -> Column:
    """The share of the dictionary's tokens that the resource's name has."""
    d = tokens(dictionary)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(d, tokens(resource))), F.size(d)), F.lit(0.0))


def header_score(fields: Column, header: Column) -> Column:
    """Jaccard similarity of normalised names; 0 if either is empty."""
    a, b = (F.array_distinct(F.transform(x, norm)) for x in (fields, header))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), overlap(a, b)).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))


def compact(c: Column) -> Column:
    """A name's letters without blanks, connectives and single letters."""
    drop = F.array(*map(F.lit, CONNECTIVES))
    return F.array_join(F.filter(words(c), lambda w: (F.char_length(w) > 1) & ~F.array_contains(drop, w)), "")


def table_key(c: Column, format_words: list[str]) -> Column:
    """The sorted words of a name without those that name a format (a word may occur twice)."""
    drop = F.array(*map(F.lit, format_words))
    return F.array_join(F.array_sort(F.filter(words(c), lambda w: ~F.array_contains(drop, w))), " ")


def clean_text(c: Column, limit: int) -> Column:
    """Without control and direction characters, cut at `limit` with a mark."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f‪-‮⁦-⁩]", "")
    return F.when(F.char_length(plain) <= limit, plain).otherwise(F.concat(F.substring(plain, 1, limit), F.lit(" […]")))


def error_text(kind: Column, message: Column, network: Column, limit: int = 200) -> Column:
    """An error as stored: whole for network errors, else the first line with quoted pieces masked, as they may quote a file."""
    first = F.regexp_extract(F.trim(F.coalesce(message, F.lit(""))), r"^([^\r\n]*)", 1)
    masked = F.regexp_replace(first, "\"[^\"]*\"|'[^']*'", "…")
    return clean_text(F.concat(kind, F.lit(": "), F.when(network, F.coalesce(message, F.lit(""))).otherwise(masked)), limit)


def safe_markdown(c: Column, limit: int = 300) -> Column:
    """Untrusted text without HTML, links, images, mentions, references and table bars."""
    out = F.regexp_replace(clean_text(c, limit), r"[\r\n]", " ")
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "/"), ("`", "'")):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, r"!?\[([^\]]*)\]\(([^)]*)\)", "$1 ($2)")
    out = F.regexp_replace(out, r"(?<![\w`])@(?=\w)", "@​")
    out = F.regexp_replace(out, r"(?<![\w&])#(?=[0-9])", "#​")
    return F.regexp_replace(out, r"(https?):(//)", "$1:​$2")


def share(n: Column, d: Column, digits: int = 4) -> Column:
    """n / d rounded; null where d is 0."""
    return F.round(F.try_divide(n.cast("double"), d), digits)


def resource_ids(c: Column) -> Column:
    """Distinct ids of resources that a text links to, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"/resource(?:_edit)?/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"), 1))


def dataset_names(c: Column) -> Column:
    """Distinct names of datasets that a text links to, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"/dataset/([a-z0-9][a-z0-9_-]{1,99})(?=[/\s\"']|$)"), 1))


def basename(url: Column) -> Column:
    return F.element_at(F.split(F.split_part(F.coalesce(url, F.lit("")), F.lit("?"), F.lit(1)), "/"), -1)


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), F.lit("")))


def next_run(day: Column) -> Column:
    """The Monday after a day: when the weekly run is."""
    return F.next_day(day, "MO")


def media_type(c: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(1))))


def member_name(member: Column, sheet: Column) -> Column:
    return F.when(F.coalesce(member, F.lit("")) == "", sheet).otherwise(F.concat_ws("#", member, sheet))


def digest(*parts: Column) -> Column:
    """16 hexadecimal digits of the SHA-256 of a canonical text: stable, and different for different parts."""
    return F.left(F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256), F.lit(16))


@F.pandas_udf(T.StringType())
def decoded(c: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8 (with or without mark), else Windows-1252, else Latin-1. The JVM functions refuse Windows-1252."""

    def one(x):
        for enc in ("utf-8-sig", "cp1252", "latin-1"):
            try:
                return bytes(x).decode(enc)
            except UnicodeDecodeError:
                continue

    return c.map(lambda x: None if x is None else one(x))


def chunks(c: Column, limit: int) -> Column:
    """A text cut at line ends into pieces of at most `limit` characters; a longer line is cut itself."""
    lines = F.flatten(F.transform(F.split(c, "\n", -1), lambda x: F.when(x == "", F.array(x)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.char_length(x) - 1) / limit).cast("int")), lambda i: F.substr(x, i * limit + 1, F.lit(limit))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc, line):
        longer = F.concat(acc["open"], F.lit("\n"), line)
        fits = F.char_length(longer) <= limit
        return (F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), line.alias("open")))
                .when(fits, F.struct(acc["done"].alias("done"), longer.alias("open")))
                .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), line.alias("open"))))

    return F.aggregate(lines, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda x: F.trim(x) != ""))
