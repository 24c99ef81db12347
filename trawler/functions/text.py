"""Text analysis as column expressions: tokenizers, the normalizing chain, field templates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawler.functions.porter2 import stem

# The English stopwords, residues of contractions, bounds on a token's length.
STOPWORDS = tuple(
    (
        "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself "
        "she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll "
        "these those am is are was were be been being have has had having do does did doing a an the and but if or because as "
        "until while of at by for with about against between into through during before after above below to from up down in "
        "out on off over under again further then once here there when where why how all any both each few more most other "
        "some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y "
        "ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
        "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
    ).split()
)
CONTRACTION_RESIDUES = ("n't", "'s", "'re", "'ve", "'ll", "'d", "'m", "'t")
MIN_TOKEN_LENGTH, MAX_TOKEN_LENGTH = 2, 40


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def simple_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit("[a-z0-9]+"), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    """Lower-cased words between white space; punctuation stays on them."""
    return F.filter(F.split(F.lower(_text(text)), r"\s+"), lambda t: t != "")


#: Treebank conventions as (pattern, replacement), applied in this order to a text padded by spaces.
TREEBANK = (
    (r"^\s*\"", " `` "),
    (r"([ (\[{<])\"", "$1 `` "),
    (r"([^.])(\.)([\])}>\"']*)\s+(?=\p{Lu})", "$1 $2$3 "),
    (r"([:,])([^\d])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"\.\.\.", " ... "),
    (r"[;@#$%&]", " $0 "),
    (r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3 "),
    (r"[?!]", " $0 "),
    (r"([^'])' ", "$1 ' "),
    (r"[\]\[(){}<>]", " $0 "),
    (r"--", " -- "),
    (r"$", " "),
    (r"\"", " '' "),
    (r"(\S)('')", "$1 $2 "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(can)(not)\b", "$1 $2"),
    (r"(?i)\b(gim|lem)(me)\b", "$1 $2"),
    (r"(?i)\b(gon|wan)(na)\b", "$1 $2"),
    (r"(?i)\b(got)(ta)\b", "$1 $2"),
)


def treebank_tokens(text: Column) -> Column:
    """Treebank tokens in lower case, without pure punctuation, residues of contractions, and tokens
    that start with an apostrophe. Sentence ends inside a text are taken where a full stop is followed
    by a capital letter; no trained sentence model is involved."""
    out = _text(text)
    for pattern, to in TREEBANK:
        out = F.regexp_replace(out, pattern, to)
    tokens = F.transform(F.split(F.trim(out), r"\s+"), F.lower)
    return F.filter(tokens, lambda t: t.rlike("[a-z0-9]") & ~t.isin(*CONTRACTION_RESIDUES) & ~t.startswith("'"))


def remove_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))


def is_kept(token: Column) -> Column:
    """Whether a token is no stopword, 2 to 40 characters long and not all digits."""
    return F.length(token).between(MIN_TOKEN_LENGTH, MAX_TOKEN_LENGTH) & ~token.isin(*STOPWORDS) & ~token.rlike(r"^\p{Nd}+$")


def kept(tokens: Column) -> Column:
    """Tokens that are no stopwords, 2 to 40 characters long and not all digits."""
    return F.filter(tokens, is_kept)


def analyzed(text: Column, tokenizer=simple_tokens) -> Column:
    """The normalizing chain without stemming."""
    return kept(tokenizer(text))


def exploded(texts: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(*keys, term): the terms of `analyzed` as rows. The filter runs on rows, where its code is compiled, not inside a list."""
    return texts.select(*keys, F.explode(simple_tokens(text)).alias("term")).where(is_kept(F.col("term")))


def field_terms(texts: DataFrame, fields: dict[str, Column], *keys: str) -> DataFrame:
    """(*keys, field, term): the terms of `analyzed` in several texts of each row, which is read once. field is the
    text's place; one more row with an empty term, and the number of texts as its field, stands for the row itself."""
    lists = [f"_tokens{i}" for i in range(len(fields))]
    rows = texts.select(*keys, *(simple_tokens(text).alias(name) for name, text in zip(lists, fields.values(), strict=True)))
    ends, total = [], F.lit(0)
    for name in lists:
        total = total + F.size(name)
        ends.append(total)
    rows = rows.select(*keys, *(end.alias(f"_end{i}") for i, end in enumerate(ends)), F.posexplode(F.concat(*lists, F.array(F.lit("")))).alias("_at", "term"))
    field = F.lit(len(fields))
    for i in reversed(range(len(fields))):
        field = F.when(F.col("_at") < F.col(f"_end{i}"), i).otherwise(field)
    # these tokens are ASCII: only what starts with a digit can be all digits
    some = F.length("term").between(MIN_TOKEN_LENGTH, MAX_TOKEN_LENGTH) & ~F.col("term").isin(*STOPWORDS) & ((F.col("term") >= ":") | ~F.col("term").rlike("^[0-9]+$"))
    return rows.where((F.col("term") == "") | some).select(*keys, field.alias("field"), "term")


def stem_vocabulary(terms: DataFrame, col: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms; a stem shorter than two characters is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stems = pdf["term"].map(stem)
            yield pdf.assign(stem=stems.where(stems.str.len() >= MIN_TOKEN_LENGTH, None))

    return terms.select(F.col(col).alias("term")).where("term is not null").distinct().mapInPandas(run, "term string, stem string")


def stemmed(analyzed_docs: DataFrame, id_col: str = "doc_id", terms_col: str = "terms") -> DataFrame:
    """(id, terms) with every term replaced by its stem and order kept; Python sees each distinct term once."""
    rows = analyzed_docs.select(id_col, F.posexplode(terms_col).alias("pos", "term"))
    stems = rows.join(stem_vocabulary(rows), "term").where("stem is not null")
    lists = stems.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stem"))), lambda x: x["stem"]).alias("terms"))
    return analyzed_docs.select(id_col).join(lists, id_col, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def full_content(title: Column, text: Column, keywords: Column) -> Column:
    """Title, text and keywords joined by one space, empty parts skipped."""
    return F.concat_ws(" ", _filled(title), _filled(text), _filled(F.concat_ws(" ", keywords)))


def contents_flat(title: Column, text: Column, keywords: Column) -> Column:
    """The same over trimmed parts."""
    parts = (F.trim(_text(title)), F.trim(_text(text)), F.trim(F.concat_ws(" ", F.filter(keywords, lambda k: k != ""))))
    return F.concat_ws(" ", *map(_filled, parts))


def contents_weighted(title: Column, text: Column, keywords: Column, weights: tuple[int, int, int]) -> Column:
    """Each field repeated as often as it weighs; a field of weight 0 vanishes."""
    parts = (F.trim(_text(title)), F.trim(_text(text)), F.trim(F.concat_ws(" ", F.filter(keywords, lambda k: k != ""))))
    repeated = [F.repeat(F.concat(p, F.lit(" ")), max(w, 0)) for p, w in zip(parts, weights, strict=True)]
    return F.trim(F.concat(*(F.when(p != "", r).otherwise("") for p, r in zip(parts, repeated, strict=True))))


def embed_text(title: Column, text: Column, keywords: Column, chars: int = 2000, prefix: str = "") -> Column:
    """What an encoder reads of a record: prefix, title, text, keywords, cut to a number of characters."""
    body = F.trim(F.concat(_text(title), F.lit(". "), _text(text), F.lit(" "), F.concat_ws(" ", keywords)))
    return F.substring(F.concat(F.lit(prefix), body), 1, chars)
