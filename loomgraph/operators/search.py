"""Keyword, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.storage import cut, numbered

# Boosts by type for keyword and for vector search.
BOOST = {"Function": 0.5, "Method": 0.5, "Class": 0.4, "Constant": 0.1, "File": 0.0}
VECTOR_BOOST = {"Function": 0.02, "Method": 0.02, "Class": 0.015, "Constant": 0.005, "File": 0.0}


def boost(type_: Column, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(type_ == k, F.lit(v)).otherwise(out)
    return out


def idf(docs: DataFrame) -> DataFrame:
    """A2: term, df, idf over the distinct tokens of name and docstring. One scan: the number of documents comes from a one-row aggregate."""
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("docstring", F.lit("")))
    terms = docs.select(F.explode(F.array_distinct(N.tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n"))
    return terms.join(F.broadcast(total)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # total: one row


def term_stats(docs: DataFrame, terms: list[str], keep: Column) -> DataFrame:
    """What the score needs of each row that has any of the terms in it: small numbers, made from its texts once and written down. keep: whether filters let the row through."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = docs.withColumns({"__name": low("name"), "__doc": low("docstring"), "__sig": low("signature")})
    rows = rows.where(N.either([F.contains(F.col(c), F.lit(t)) for t in terms for c in ("__name", "__doc", "__sig")]))
    rows = rows.withColumns({f"{c}_tokens": N.tokens(F.col(c)) for c in ("__name", "__doc", "__sig")})
    name, sig, name_tokens, doc_tokens = (F.col(c) for c in ("__name", "__sig", "__name_tokens", "__doc_tokens"))
    of = lambda toks, t: F.size(toks) - F.size(F.array_remove(toks, t))
    out = [F.size(name_tokens).alias("names"), F.size(doc_tokens).alias("words")]
    for k, t in enumerate(terms):
        out += [of(name_tokens, t).alias(f"n{k}"), of(doc_tokens, t).alias(f"d{k}"), F.contains(sig, F.lit(t)).alias(f"s{k}")]
        out.append(F.when(name == t, 2).when(F.contains(name, F.lit(t)), 1).otherwise(0).alias(f"e{k}"))
    if len(terms) > 1:
        joined, spaced, full = F.lit("_".join(terms)), F.lit(" ".join(terms)), F.concat_ws(" ", "__name", "__doc", "__sig")
        all_in = F.lit(True)
        for t in terms:
            all_in = all_in & (F.contains(name, F.lit(t)) | F.contains(F.col("__doc"), F.lit(t)) | F.contains(sig, F.lit(t)))
        out.append(F.when(F.contains(name, joined) | F.contains(full, joined), 500.0).when(F.contains(full, spaced), 200.0).otherwise(0.0).alias("phrase"))
        out.append(F.when(all_in, proximity(F.concat("__name_tokens", "__doc_tokens", "__sig_tokens"), terms)).otherwise(False).alias("near"))
    return cut(rows.select("id", "ord", "type", "in_degree", keep.alias("keep"), *out))


def score(terms: list[str], idfs: list[Column]) -> Column:
    """The keyword score of a row of term_stats."""
    total, found = F.lit(0.0), F.lit(0)
    for k, weight in enumerate(idfs):
        in_name, in_doc, in_sig = F.col(f"n{k}") / F.greatest("names", F.lit(1)), F.col(f"d{k}") / F.greatest("words", F.lit(1)), F.col(f"s{k}")
        total = total + in_name * weight * 10 + in_doc * weight + F.when(in_sig, weight * 2).otherwise(0.0)
        total = total + F.when(F.col(f"e{k}") == 2, F.lit(50.0)).when(F.col(f"e{k}") == 1, weight * 5).otherwise(0.0)
        found = found + F.when((in_name > 0) | (in_doc > 0) | in_sig, 1).otherwise(0)
    if len(terms) > 1:
        part = found / F.lit(len(terms))
        whole = 1000 + total * 2 + F.col("phrase") + F.when(F.col("near"), 100.0).otherwise(0.0)
        total = F.when(found == len(terms), whole).when(found > 0, F.least(total * part * part, F.lit(999.0))).otherwise(total)
    more = boost(F.col("type"), BOOST, 0.2) + F.when(F.col("in_degree") > 0, F.log(1 + F.col("in_degree")) * 5).otherwise(0.0)
    return F.when(total > 0, total + more).otherwise(F.lit(0.0))


def proximity(tokens: Column, terms: list[str]) -> Column:
    """Whether all terms are among the tokens from some first term on, as many as there are terms and two more."""
    from functools import reduce

    def at(i: Column) -> Column:
        window = F.slice(tokens, i, len(terms) + 2)
        return reduce(lambda a, b: a & b, [F.array_contains(window, t) for t in terms])

    places = F.filter(F.transform(tokens, lambda x, i: F.when(x == terms[0], i + 1)), lambda i: i.isNotNull())
    return F.exists(places, at)


def search(docs: DataFrame, terms: list[str], limit: int = 10, lang: str | None = None, crate: str | None = None, symbol_type: str | None = None, exclude_tests: bool = False) -> DataFrame:
    """The best rows for some terms; frequencies count all rows. An unknown crate gives nothing; an unknown language or type is no filter."""
    terms = [t.lower() for t in terms if t and t.strip()]
    if not terms:
        return docs.limit(0).select("id", "ord", F.lit(0.0).alias("score"))
    keep = F.lit(True)
    if exclude_tests:
        keep = keep & ~F.col("is_test")
    if crate:
        keep = keep & (F.col("crate") == crate)
    if lang and lang != "all" and not docs.where(F.col("lang") == lang).isEmpty():
        keep = keep & (F.col("lang") == lang)
    kind = (symbol_type or "").capitalize()
    if kind in BOOST:
        keep = keep & (F.col("type") == kind)
    rows = term_stats(docs, terms, F.coalesce(keep, F.lit(False)))
    seen = rows.agg(*[F.count_if((F.col(f"n{k}") > 0) | (F.col(f"d{k}") > 0)).alias(f"df{k}") for k in range(len(terms))])
    total = docs.agg(F.count("*").alias("n"))
    idfs = seen.join(total).select(*[F.when(F.col(f"df{k}") > 0, F.log((F.col("n") + 1) / (F.col(f"df{k}") + 1)) + 1).otherwise(1.0).alias(f"idf{k}") for k in range(len(terms))])
    rows = rows.where("keep").join(F.broadcast(idfs))  # idfs: one row
    value = score(terms, [F.col(f"idf{k}") for k in range(len(terms))])
    return rows.select("id", "ord", value.alias("score")).where("score > 0").orderBy(F.desc("score"), "ord").limit(limit)


def nearest(vectors: DataFrame, query: list[float], limit: int = 10, least: float = 0.3) -> DataFrame:
    """Vectors nearest by cosine, three times as many as wanted, ranked again with boosts for in-degree and type."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = vectors.withColumn("cosine", N.cosine(F.col("vector"), q)).where(F.col("cosine") >= least).orderBy(F.desc("cosine"), "id").limit(3 * limit)
    more = F.least(F.lit(0.15), F.log(1 + F.col("in_degree")) * 0.03) + boost(F.col("type"), VECTOR_BOOST, 0.01)
    return near.select("id", "cosine", (F.col("cosine") + more).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def composite(name: Column, signature: Column, doc: Column) -> Column:
    """C11: the weighted sum of three vectors, scaled to length one (a zero vector stays). A null signature or doc counts as the name."""
    parts = [(name, 0.2), (F.coalesce(signature, name), 0.3), (F.coalesce(doc, name), 0.5)]
    (a, p), (b, q), (c, r) = parts
    mixed = F.zip_with(F.zip_with(a, b, lambda x, y: x.cast("double") * p + y.cast("double") * q), c, lambda x, y: x + y.cast("double") * r)
    length = F.sqrt(F.aggregate(mixed, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(mixed, lambda x: x / F.when(length == 0, F.lit(1.0)).otherwise(length))


def embedded_texts(most: int = 500) -> dict[str, Column]:
    """C11: what a model is to encode of a node: name (or the end of its id), signature and the first part of the docstring; null where there is none."""
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    return {"name": F.coalesce(filled("name"), F.substring_index("id", "::", -1)), "signature": filled("signature"), "doc": F.substring(filled("docstring"), 1, most)}


def fuse(a: DataFrame, b: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, rank from 0)."""
    both = a.select("id", F.col("rank").alias("ra")).join(b.select("id", F.col("rank").alias("rb")), "id", "full_outer")
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(r) + 1), F.lit(0.0))
    return both.select("id", (part("ra") + part("rb")).alias("score"))


def ranked(df: DataFrame, *order) -> DataFrame:
    """Rank from 0 in an order."""
    return numbered(df, "rank", *order)
