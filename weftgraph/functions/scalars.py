"""Column expressions for titles, categories, activations and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A title with a year in brackets at its end, a fixed value; titles without one count as of NO_YEAR.
TITLE = r"^(.+)\s*\((\d+)\)"
NO_YEAR = 1950
#: Names that mean the genre Children, fixed values.
CHILDREN = ("Children's", "Childrens")


def title_text(title: Column) -> Column:
    return F.when(title.rlike(TITLE), F.regexp_extract(title, TITLE, 1)).otherwise(title)


def title_year(title: Column) -> Column:
    return F.when(title.rlike(TITLE), F.regexp_extract(title, TITLE, 2).cast("int")).otherwise(NO_YEAR)


def scaled_year(year: Column) -> Column:
    return (year - 1950) / 100.0


def one_hot(value: Column, domain: list[str]) -> Column:
    return F.transform(F.array(*[F.lit(d) for d in domain]), lambda d: F.coalesce((d == value).cast("float"), F.lit(0.0).cast("float")))


def genre_flags(genres: Column, vocabulary: list[str]) -> Column:
    """Flags of a `|`-joined list; names outside the vocabulary count as `unknown` where that is one of its names, else for nothing."""
    parts = F.transform(F.split(genres, r"\|"), lambda g: F.when(g.isin(*CHILDREN), "Children").otherwise(g))
    names = F.array(*[F.lit(v) for v in vocabulary])
    odd = F.exists(parts, lambda g: ~F.array_contains(names, g))
    return F.transform(names, lambda v: (F.array_contains(parts, v) | ((v == "unknown") & odd)).cast("int"))


def activation(name: str, x: Column, slope: float = 0.1) -> Column:
    """leaky, identity, elu, relu, sigmoid, tanh, softrelu or softsign of a column."""
    found = {
        "leaky": F.when(x > 0, x).otherwise(slope * x),
        "identity": x,
        "elu": F.when(x > 0, x).otherwise(F.exp(x) - 1),
        "relu": F.greatest(x, F.lit(0.0)),
        "sigmoid": 1 / (1 + F.exp(-x)),
        "tanh": F.tanh(x),
        "softrelu": F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))),
        "softsign": x / (1 + F.abs(x)),
    }
    if name not in found:
        raise ValueError(f"unknown activation {name!r}")
    return found[name]


def rounded(x: Column, decimals: int) -> Column:
    """A double as SQL rounds it: scaled by a power of ten, halves away from zero, scaled back. F.round looks at the shortest decimal
    digits instead, which rounds some halves the other way."""
    scaled = x.cast("double") * 10.0**decimals
    near = F.rint(scaled)
    whole = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near) / 10.0**decimals
    return F.when(F.abs(whole) == float("inf"), x.cast("double")).otherwise(whole) + 0.0


def standardize(x: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(x - mean, std)


def clipped(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(x, high), low)


def normalize_vectors(nodes: DataFrame, dim: int) -> DataFrame:
    """(id, vector) with each component less its mean over its population deviation; a deviation of 0 divides by 1."""
    x = [F.get("vector", F.lit(i)).cast("double") for i in range(dim)]
    stats = nodes.agg(F.array(*[F.avg(c) for c in x]).alias("_m"), F.array(*[F.stddev_pop(c) for c in x]).alias("_s"))
    scaled = F.transform("vector", lambda v, i: (v.cast("double") - F.get("_m", i)) / F.when(F.get("_s", i) == 0, 1.0).otherwise(F.get("_s", i)))
    return nodes.crossJoin(F.broadcast(stats)).select("id", scaled.alias("vector"))


def token_means(texts: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(id, vector): the mean of the vectors of a text's tokens (token, vector); texts (id, text) without known tokens get zeros."""
    tokens = texts.select("id", F.explode(F.split(F.lower("text"), r"\s+")).alias("token"))
    x = [F.avg(F.get("vector", F.lit(i)).cast("double")).alias(f"c{i}") for i in range(dim)]
    mean = tokens.join(vectors, "token").groupBy("id").agg(*x).select("id", F.array(*[f"c{i}" for i in range(dim)]).alias("vector"))
    return texts.select("id").join(mean, "id", "left").select("id", F.coalesce("vector", F.array_repeat(F.lit(0.0), dim)).alias("vector"))
